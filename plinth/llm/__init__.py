"""Operators for corpora of documents. Nothing else in the library imports this subpackage."""
