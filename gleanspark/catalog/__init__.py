"""Every operator as a named query over the given tables, with an independent SQL statement."""

from gleanspark.catalog.registry import ORACLES, QUERIES, load_all

__all__ = ["ORACLES", "QUERIES", "load_all"]
