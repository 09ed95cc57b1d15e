"""Streams of queries against tables of vectors."""
