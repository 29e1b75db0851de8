"""Reading and writing: delimited quarter files, Parquet tables, fixtures and reports."""
