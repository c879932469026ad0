"""Analytics over compressed vectors, as DataFrames."""
