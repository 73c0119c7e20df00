"""Operators for preparing text corpora for language-model training.

Nothing else in the library imports this subpackage; removing it leaves the
rest of the engine as it is.
"""
