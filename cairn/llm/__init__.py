"""Operators that prepare a text corpus for training. Nothing outside this package imports it."""
