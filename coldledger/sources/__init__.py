"""Scans: files on storage -> DataFrames with explicit schemas."""
