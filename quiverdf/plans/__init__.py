"""Named queries that apply the operators to the tables of a folder."""
