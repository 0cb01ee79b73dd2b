"""Readers and writers: external files in, typed DataFrames out, and back."""
