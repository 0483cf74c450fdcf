"""Operators for large language models' training data; nothing else in the library imports this."""
