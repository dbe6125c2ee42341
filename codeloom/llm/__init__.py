"""Operators that prepare text collections for language models; nothing outside this package imports it."""
