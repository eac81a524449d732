"""Spark jobs over panels of market price series, forecast requests and training text."""
