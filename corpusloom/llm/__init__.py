"""Training-data operators for very large text corpora.

Nothing else in the library imports this subpackage; it can be removed without
touching the rest.
"""
