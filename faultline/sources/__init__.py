"""Scans: files and text to DataFrames."""
