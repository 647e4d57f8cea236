"""Operators for preparing training data: filters, classifiers, joins, archives, scoring.

Nothing else in the library imports this subpackage.
"""
