"""Corpus preparation operators for training data: thirteen operators, their queries and their SQL."""
