"""Operators on text and samples for training data. Nothing outside imports this subpackage."""
