"""Operators for preparing training data: chat text, filters, packing, shards.

Every operator works on any DataFrame with the columns it names, ignores other
columns, and states in its docstring what nulls, empty texts, ties and repeated
rows give.  ``queries()`` binds the operators to the driver tables.
"""
