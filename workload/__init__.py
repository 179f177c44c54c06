"""The engine applied to the given tables: stand-in sources, queries and their SQL twins."""
