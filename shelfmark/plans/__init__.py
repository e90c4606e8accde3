"""Whole jobs made of the operators: catalog cleaning and the searches."""
