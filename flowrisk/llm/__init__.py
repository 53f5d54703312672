"""Operators for training-data pipelines: documents, conversations and embeddings."""
