"""Operators for preparing language-model training text.

Nothing else in the library imports this package.  Each module holds one
operator with a general interface; ``queries`` applies each to its table.
"""
