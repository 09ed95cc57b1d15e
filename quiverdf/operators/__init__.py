"""Operators over tables of vectors: search, sampling, quantisation, clustering, indexes, ordering, evaluation."""
