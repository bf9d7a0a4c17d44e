"""Readers: sources as DataFrames with explicit schemas."""
