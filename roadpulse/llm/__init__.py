"""Operators for the making of training text; nothing else in the library imports this folder."""
