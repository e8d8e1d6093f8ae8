"""Queries: operators applied to the driver's tables, each with SQL that another engine can run."""
