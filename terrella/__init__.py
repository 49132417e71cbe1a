"""Gridded analytics on Spark: rasters as cell tables, operators as DataFrame plans."""
