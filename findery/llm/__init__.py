"""Operators that prepare large text corpora for training; nothing else in the library imports them."""
