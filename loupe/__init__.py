"""Loupe: a forensic analytics engine for document corpora, built on Spark DataFrames."""
