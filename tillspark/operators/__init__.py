"""One module for each operator family; functions take and return DataFrames."""
