"""Derived tables and the registry of named queries."""
