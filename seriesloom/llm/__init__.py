"""Operators for text corpora and record linkage; nothing else in the library imports this subpackage."""
