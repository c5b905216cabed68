"""PDF files as DataFrames."""
