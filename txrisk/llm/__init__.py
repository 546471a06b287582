"""Operators for training-data corpora. ``queries`` registers one query per operator."""
