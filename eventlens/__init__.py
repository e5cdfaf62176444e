"""eventlens: finding events in dated short texts with Spark DataFrames."""
