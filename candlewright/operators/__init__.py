"""operators of the price-series library."""
