"""Query plans over the parquet tables: views, registered queries and their SQL twins."""
