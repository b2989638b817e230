"""Operators for training data that is made from agent traces."""
