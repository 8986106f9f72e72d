"""Registered queries.  Importing `riskloom.plans.catalog` fills the registry."""
