"""Registered queries: every operator run over the driver's tables, each with an independent SQL oracle where one
can be written."""

from ranklab.catalog.registry import QUERIES, ORACLES, load_all

__all__ = ["QUERIES", "ORACLES", "load_all"]
