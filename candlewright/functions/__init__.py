"""functions of the price-series library."""
