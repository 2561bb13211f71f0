"""The query registry and the shared SQL fragments of the oracles."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ranklab.session import settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PENDING: dict[str, tuple[tuple[str, ...], str]] = {}
FRAGMENTS: dict[str, tuple[tuple[str, ...], str]] = {}
MODULES = ("ingestion", "taxonomies", "texts", "channels", "hubs", "lists", "pooling", "pairs", "judgments", "scores",
           "raters", "ranking", "flagship", "reports", "providers")


def query(name: str, sql: str | None = None, needs: tuple[str, ...] = ()):
    """Register `fn(spark, sf_dir)`; `sql` may use the fragments in `needs` as tables."""
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(settle(spark), sf_dir)
        QUERIES[name].__module__ = fn.__module__
        if sql is not None:
            PENDING[name] = (needs, sql)
        return fn
    return register


def shown6(name: str, out: str | None = None) -> Column:
    """A score an operator has rounded to 9 decimals, shown with 6. The offset keeps a ...5 in the seventh place from
    being a tie, which engines round differently."""
    return (F.round(F.col(name) + F.lit(2.5e-10), 6) + F.lit(0.0)).alias(out or name)


def sql6(name: str = "score", out: str | None = None) -> str:
    return f"round({name} + 2.5e-10, 6) + 0.0 AS {out or name}"


def shown9(name: str, out: str | None = None) -> Column:
    """The same for scores rounded to 12 decimals."""
    return (F.round(F.col(name) + F.lit(2.5e-13), 9) + F.lit(0.0)).alias(out or name)


def sql9(name: str = "score", out: str | None = None) -> str:
    return f"round({name} + 2.5e-13, 9) + 0.0 AS {out or name}"


def fragment(name: str, sql: str, needs: tuple[str, ...] = ()) -> None:
    FRAGMENTS[name] = (needs, sql)


def with_fragments(names: tuple[str, ...], body: str) -> str:
    """WITH clause of the fragments and everything they need, in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in FRAGMENTS[name][0]:
            visit(dep)
        order.append(name)

    for name in names:
        visit(name)
    if not order:
        return body.strip()
    body = body.strip()
    head = "WITH " + ",\n".join(f"{n} AS ({FRAGMENTS[n][1].strip()})" for n in order)
    if body.upper().startswith("WITH "):
        return head + ",\n" + body[5:]
    return head + "\n" + body


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"ranklab.catalog.{name}")
    ORACLES.update({name: with_fragments(needs, sql) for name, (needs, sql) in PENDING.items()})
