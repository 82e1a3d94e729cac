"""quartzite: panel and microstructure analytics on Spark DataFrames."""
