"""Table-level jobs: DataFrames in, DataFrames out."""
