"""Operators: chunking, dense and lexical retrieval, the similarity graph."""
