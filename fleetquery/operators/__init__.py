"""Operators from DataFrames to DataFrames. None collects rows on the driver
but for the bounded ones that say so."""
