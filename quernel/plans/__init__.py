"""From SQL text to lazy DataFrames."""
