"""lamina: columnar query building blocks as lazy Spark DataFrames."""
