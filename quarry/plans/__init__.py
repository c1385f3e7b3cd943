"""The catalog of registered queries and their SQL twins."""
