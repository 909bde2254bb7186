"""Operators for training-data pipelines over the ``documents``-like tables.

Nothing else in the library imports this subpackage. All operators share these rules: only the
columns named in a docstring are read, so extra columns (with whatever names) never clash; a null
text is the empty text; a null ``doc_id`` stays null in the result; an empty table gives an empty
result of the same schema.
"""
