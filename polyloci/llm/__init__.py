"""Training-data pipeline operators: DataFrames in, DataFrames out."""
