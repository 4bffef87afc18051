"""Rental-listing and geospatial analytics, and corpus operators, on Spark DataFrames."""
