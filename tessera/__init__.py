"""A strict single-table SQL engine and table store expressed on PySpark DataFrames."""
