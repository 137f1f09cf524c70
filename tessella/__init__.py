"""tessella: raster dataflow and corpus processing as Spark DataFrames."""
