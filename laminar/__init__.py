"""laminar: scan, lookup, profiling and inspection of wide columnar tables on Spark DataFrames."""
