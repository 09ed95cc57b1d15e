"""Vector-search analytics over columns of embeddings, as Spark plans."""
