"""Where pages come from and go to: Parquet tables, files and streams of files."""
