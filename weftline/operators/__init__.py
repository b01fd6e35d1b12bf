"""Dataset operators. They take and return DataFrames and never collect rows."""
