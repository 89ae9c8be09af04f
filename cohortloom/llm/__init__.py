"""Operators that prepare documents, pages and embeddings for training language models."""
