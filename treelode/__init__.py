"""treelode: index trees of source code and documentation with Spark and query them as DataFrames."""
