"""Operators over document text: tokens, packing and language. Nothing else in the library imports this."""
