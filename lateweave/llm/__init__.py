"""Corpus-preparation operators for training data. Nothing outside imports this."""
