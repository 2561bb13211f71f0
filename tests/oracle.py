"""Runs a registered query and its SQL oracle on the same tables and compares them value by value."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    if hasattr(value, "item"):
        return _cell(value.item())
    return value


def _kind(text: str) -> str:
    text = text.lower()
    if text.startswith(("array", "list")) or text.endswith("[]"):
        return "array"
    for kinds, name in ((("bigint", "int", "long", "smallint", "tinyint", "integer", "hugeint"), "int"),
                        (("double", "float", "decimal"), "float"), (("string", "varchar"), "string"), (("bool",), "bool"),
                        (("timestamp",), "timestamp"), (("date",), "date")):
        if text.startswith(kinds):
            return "hugeint" if text == "hugeint" else name
    return text


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, otherwise what differs."""
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    kinds = {c[0]: _kind(str(c[1])) for c in rel.description}
    want_rows = rel.fetchall()
    got_names = spark_df.columns
    if sorted(names) != sorted(got_names):
        return f"columns {sorted(got_names)} != {sorted(names)}"
    got_kinds = {n: _kind(t) for n, t in spark_df.dtypes}
    off = {n: (got_kinds[n], kinds[n]) for n in names if got_kinds[n] != kinds[n]}
    if off:
        return f"types {off}"
    order = sorted(names)
    got = sorted((tuple(_cell(r[c]) for c in order) for r in spark_df.collect()), key=repr)
    at = {n: i for i, n in enumerate(names)}
    want = sorted((tuple(_cell(r[at[c]]) for c in order) for r in want_rows), key=repr)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; first got {got[:2]} want {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, columns {order}, e.g. got {bad[0][0]} want {bad[0][1]}"
    return None if got else "empty on both sides"
