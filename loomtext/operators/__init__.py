"""Corpus operators: DataFrame in, DataFrame out."""
