"""Operators that prepare text corpora for language models; nothing else in the package imports them."""
