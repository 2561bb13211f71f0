"""Operators of a training-data pipeline over documents, pages and vectors. Nothing else in the library imports them.

Conventions shared by all operators: they read the columns they are given by name and return only their own, so extra
columns cannot clash; a row is identified by its id column, and rows repeated under one id get the same decision; a null
text counts as an empty one unless the docstring says otherwise; an empty table gives an empty result.
"""
