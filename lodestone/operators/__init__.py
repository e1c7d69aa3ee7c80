"""Relational operators of retrieval, routing, answering and the question bank."""
