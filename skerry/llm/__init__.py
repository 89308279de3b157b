"""Training-data operators: one module per operator, all built on DataFrames."""
