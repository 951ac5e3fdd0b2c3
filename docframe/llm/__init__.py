"""Operators for preparing training text. Nothing else in docframe imports this."""
