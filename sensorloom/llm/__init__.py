"""Operators of a training-data pipeline over `documents`, `embeddings` and `pages`. Nothing else imports this package."""
