"""Operators for building training corpora out of raw pages and documents."""
