"""Operators for preparing language-model training data.

Each module holds one operator with its own interface; ``queries`` holds the
thin registered queries over the driver tables.  Nothing outside this
subpackage imports it.
"""
