"""Content-type detection and file-content analytics over DataFrames: a file, or any binary or text column, is a row."""
