"""Reading, writing and making tables of vectors, and stores of results."""
