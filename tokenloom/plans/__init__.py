"""Registered queries by family: each a Spark plan and, where SQL can express it, its SQL."""
