"""plans of the price-series library."""
