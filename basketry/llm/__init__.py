"""Training-data operators over a ``documents`` table.

Each module holds one operator with its own general interface; ``queries``
registers the thin per-operator queries and their SQL. Nothing outside this
subpackage imports it.
"""
