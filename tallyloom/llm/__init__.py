"""Operators for large collections of training text and its identifiers; nothing outside imports this subpackage."""
