"""Operators that prepare data for language-model training; nothing outside imports this."""
