"""Operators for preparing text corpora: one module per operator, one ``opN_*`` query each."""
