"""Operators and queries for preparing language-model training data.

Nothing outside this subpackage imports it; ``queries`` holds the registered
queries, one module per operator holds the rest.
"""
