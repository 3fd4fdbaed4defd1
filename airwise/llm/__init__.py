"""Training-data operators (thirteen numbered operators) and their registered queries.

Nothing else in the library imports this subpackage.  ``queries`` holds the registry
(``QUERIES`` and ``ORACLE``); every other module holds one operator.
"""
