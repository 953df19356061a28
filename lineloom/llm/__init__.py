"""Operators for preparing large language-model training corpora.

Nothing outside this subpackage imports it.  Each module holds one operator with
its general interface; `queries` applies every operator to its whole table.
"""
