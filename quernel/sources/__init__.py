"""Where tables are kept: Parquet files and the snapshots over them."""
