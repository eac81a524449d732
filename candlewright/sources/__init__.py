"""sources of the price-series library."""
