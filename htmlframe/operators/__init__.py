"""Spark operators: pages in, tables of documents, nodes, tokens, events, matches and text out."""
