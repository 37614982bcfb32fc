"""From syntax tree to DataFrames."""
