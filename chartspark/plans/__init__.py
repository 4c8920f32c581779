"""Queries on the driver tables, each with its SQL twin where SQL can state it."""
