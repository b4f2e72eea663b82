"""DuckDB statements that restate the registered queries over the same tables."""
from oracles.build import statement

__all__ = ["statement"]
