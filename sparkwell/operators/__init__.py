"""Relational operators over documents, chunks, vectors and queries."""
