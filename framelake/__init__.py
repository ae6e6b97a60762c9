"""framelake: labelled time series, event streams and their models on Spark DataFrames."""
