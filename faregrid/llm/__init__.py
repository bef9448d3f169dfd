"""Operators that prepare text corpora for training. Nothing else in the library imports them."""
