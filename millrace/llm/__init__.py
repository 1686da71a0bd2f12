"""Operators for preparing training text and other model-facing data; nothing else in the package imports this."""
