"""Where tables lie: sorted Parquet, the binary table file, and the change log."""
