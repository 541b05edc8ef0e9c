"""Relational operators over documents, chunks and graphs."""
