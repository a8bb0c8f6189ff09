"""Content reconciliation on PySpark: identity, deduplication, path planning, HTML work and proof that no item is lost."""
