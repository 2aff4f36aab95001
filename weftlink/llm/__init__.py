"""Operators for text corpora used to train language models."""
