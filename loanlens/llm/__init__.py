"""Training-data operators over text tables.

Each module holds one operator with a general interface, the registered
query ``opN_<name>`` that applies it to a driver table, and its DuckDB SQL
where SQL can express it. Nothing else in the library imports this package.
"""
