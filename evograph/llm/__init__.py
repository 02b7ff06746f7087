"""Operators for preparing language-model training data, ten of them, each by one named method.

Nothing else in the library imports this subpackage.
"""
