"""Operators for building training corpora of text, one module for each."""
