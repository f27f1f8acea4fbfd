"""Operators for preparing training corpora. Nothing else in lexmill imports this subpackage."""
