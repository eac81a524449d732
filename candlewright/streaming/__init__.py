"""streaming of the price-series library."""
