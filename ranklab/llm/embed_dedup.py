"""Near-duplicate vectors by an exact metric range join.

Vectors of one label are scaled to length one, where a cosine of at least c is a distance of at most r = sqrt(2 - 2c).
Pivots split a label: a vector within r / 2 of its nearest pivot lives in the pivot's ball, any other in the pivot's
outer cell. All of a ball are linked to each other by the triangle inequality, so a ball of thousands of copies needs no
comparison inside. A vector is replicated to every ball it could reach (distance to the pivot at most 1.5 r) and to
every outer cell whose bisecting plane is at most r away. Cells then join independently: what lives there against what
came. Cells over a size are cut into slices, with the guests copied to each slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ranklab.llm.common import bounded_rows, per_batch, written
from ranklab.llm.components import connected_components
from ranklab.session import union_all

MIN_COSINE = 0.93
#: Vectors drawn to choose pivots from, most pivots of a label and of all labels, and residents of one slice of a cell.
PIVOT_SAMPLE = 8_192
PIVOTS_PER_LABEL = 12
MAX_PIVOTS = 2_048
CELL_ROWS = 4_096
#: Vectors compared with vectors at a time.
CHUNK = 1_024
#: Distances this close to a bound are treated as inside it; verified pairs are decided by their cosine alone.
SLACK = 1e-6


def unit(raw: list) -> np.ndarray | None:
    """The vector in double precision at length one, or None if it links with nothing (null, zero, null or non-finite
    components)."""
    if raw is None or not len(raw) or any(x is None for x in raw):
        return None
    v = np.asarray(raw, dtype=np.float64)
    if not np.isfinite(v).all():
        return None
    top = np.abs(v).max()
    if top == 0:
        return None
    v = v / top
    return v / np.linalg.norm(v)


def unit_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, unit vector as packed doubles) of the rows that can link; a null label cannot."""
    def work(batch: pa.RecordBatch) -> dict:
        units = [unit(x) for x in batch.column("_v").to_pylist()]
        return {"unit": [None if u is None else u.astype("<f8").tobytes() for u in units]}

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("_v"))
    rows = rows.filter("id is not null and label is not null")
    return per_batch(rows, ["id", "label", "_v"], "id long, label string, unit binary", work, keep=["id", "label"]).filter("unit is not null")


def choose_pivots(sample: list[tuple[str, np.ndarray]], radius: float, per_label: int = PIVOTS_PER_LABEL) -> dict[tuple[str, int], np.ndarray]:
    """Pivots [pivot, dimension] per label and length of vector, from a sample: first the vectors with most neighbours
    within half the radius, so that groups of copies get a ball, and then the farthest from those chosen."""
    grouped: dict[tuple[str, int], list[np.ndarray]] = {}
    for label, v in sample:
        grouped.setdefault((label, len(v)), []).append(v)
    allowed = max(1, min(per_label, MAX_PIVOTS // max(1, len(grouped))))
    out = {}
    for key, rows in sorted(grouped.items()):
        x = np.stack(rows)[:2048]
        apart = np.sqrt(np.maximum(0, 2 - 2 * x @ x.T))
        close = apart <= radius / 2
        free = np.ones(len(x), dtype=bool)
        chosen: list[int] = []
        while len(chosen) < allowed // 2:
            crowd = close[:, free].sum(axis=1) * free
            best = int(crowd.argmax())
            if crowd[best] < max(3, len(x) // 200):
                break
            chosen.append(best)
            free &= ~close[best]
        far = apart[:, chosen].min(axis=1) if chosen else np.full(len(x), 2.0)
        while len(chosen) < min(allowed, len(x)):
            best = int(far.argmax())
            if far[best] <= 0:
                break
            chosen.append(best)
            far = np.minimum(far, apart[best])
        out[key] = x[chosen]
    return out


def assign(x: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For vectors x: home cell (2p: ball of pivot p, 2p + 1: outer cell), and as bit rows the balls and outer cells each
    must visit; last, whether each is at home in a ball."""
    squared = np.maximum(0, 2 - 2 * x @ pivots.T)
    apart = np.sqrt(squared)
    near = apart.argmin(axis=1)
    rows = np.arange(len(x))
    ball = apart[rows, near] <= radius / 2 - SLACK
    visit_ball = apart <= 1.5 * radius + SLACK
    between = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))[near]
    plane = (squared - squared[rows, near][:, None]) / (2 * np.maximum(between, 1e-12))
    visit_outer = ((plane <= radius + SLACK) | (between < 1e-9)) & (apart >= radius / 2 - radius - SLACK)
    return 2 * near + ~ball, visit_ball, visit_outer, ball


class CellTask:
    """One task of a cell: residents first, then guests, who pass in chunks. `counts` are the links of residents with the
    others seen here, `links` connect what is linked. Residents of a ball are linked by the triangle inequality: their
    mutual links are counted by the caller, and one link from each to the cell's least id ties them together."""

    def __init__(self, is_ball: bool, first: bool, least: int, cosine: float) -> None:
        self.is_ball, self.first, self.least, self.cosine = is_ball, first, least, cosine
        self.ids: list[int] = []
        self.units: list[bytes] = []
        self.guests: list[int] = []
        self.guest_units: list[bytes] = []
        self.links: list[tuple[int, int]] = []
        self.x: np.ndarray | None = None

    def add(self, home: bool, row: int, packed: bytes) -> None:
        if home:
            self.ids.append(row)
            self.units.append(packed)
        else:
            self.guests.append(row)
            self.guest_units.append(packed)
            if len(self.guests) >= CHUNK:
                self.compare_guests()

    def _settle(self) -> None:
        if self.x is not None:
            return
        self.own = np.array(self.ids, dtype=np.int64)
        self.counts = np.zeros(len(self.ids), dtype=np.int64)
        self.x = _matrix(self.units)
        if self.is_ball:
            if self.first:
                self.links += [(self.least, i) for i in self.ids if i != self.least]
        elif self.first:
            for low in range(0, len(self.own), CHUNK):
                self._compare(self.own[low:low + CHUNK], self.x[low:low + CHUNK], low)

    def _compare(self, ids: np.ndarray, y: np.ndarray, same: int | None = None) -> None:
        """Residents against y; `same` says where y starts among the residents themselves."""
        for low in range(0, len(self.own), CHUNK):
            linked = self.x[low:low + CHUNK] @ y.T >= self.cosine
            if same == low:
                np.fill_diagonal(linked, False)
            self.counts[low:low + CHUNK] += linked.sum(axis=1)
            if self.is_ball:
                # The residents hang together already: one link for each guest is enough.
                some = np.flatnonzero(linked.any(axis=0))
                self.links += zip(self.own[low + linked[:, some].argmax(axis=0)].tolist(), ids[some].tolist())
            else:
                a, b = np.nonzero(linked)
                self.links += _forest(self.own[low + a], ids[b])

    def compare_guests(self) -> None:
        self._settle()
        if self.guests and len(self.own):
            self._compare(np.array(self.guests, dtype=np.int64), _matrix(self.guest_units))
        self.guests, self.guest_units = [], []

    def result(self) -> pa.RecordBatch:
        self.compare_guests()
        a = [*self.ids, *(p for p, _ in self.links)]
        b = [None] * len(self.ids) + [q for _, q in self.links]
        n = [*self.counts.tolist(), *[0] * len(self.links)]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "n"])


def _matrix(packed: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(packed), dtype="<f8").reshape(len(packed), -1) if packed else np.zeros((0, 0))


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links a[i] - b[i]."""
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while root.setdefault(v, v) != v:
            root[v] = v = root[root[v]]
        return v

    out = []
    for u, v in zip(a.tolist(), b.tolist()):
        p, q = find(u), find(v)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((u, v))
    return out


def near_vectors(vectors: DataFrame, cosine: float = MIN_COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 cell_rows: int = CELL_ROWS) -> DataFrame:
    """Per row: id, `n_links` (other vectors of the same label with a cosine of at least `cosine`), `component_id` (the
    smallest id reachable over links) and `kept` (it is its own component_id).

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label, link with
    nothing; so do vectors of different length. Ids are integers; rows repeated under one id are separate vectors that
    share their id's counts (their links add up) and component. A row with a null id has no links and a null component.
    Every pair is decided in double precision. The answer does not depend on the pivots, only the work does: vectors
    without clusters are replicated to nearly all cells of their label, and the join is then quadratic in a label.
    """
    radius = sqrt(2 - 2 * cosine)
    units = written(unit_vectors(vectors, id_col, vector_col, label_col), "units")
    sample = bounded_rows(units.select("label", "unit", F.xxhash64("id", "unit").alias("h")).orderBy("h", "label").limit(PIVOT_SAMPLE), PIVOT_SAMPLE, "pivot sample")
    pivots = choose_pivots([(r["label"], np.frombuffer(r["unit"], dtype="<f8")) for r in sample], radius)
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, packed = (batch.column(k).to_pylist() for k in range(3))
            groups: dict[tuple[str, int], list[int]] = {}
            for i, (label, u) in enumerate(zip(labels, packed)):
                groups.setdefault((label, len(u) // 8), []).append(i)
            out: dict[str, list] = {k: [] for k in ("label", "cell", "home", "id", "unit")}
            for key, rows in groups.items():
                ref = shared.value.get(key)
                if ref is None:
                    found = [(i, 1, True) for i in rows]
                else:
                    x = np.frombuffer(b"".join(packed[i] for i in rows), dtype="<f8").reshape(len(rows), -1)
                    home, balls, outer, _ = assign(x, ref, radius)
                    found = [(i, int(h), True) for i, h in zip(rows, home)]
                    for kind, visits in ((0, balls), (1, outer)):
                        a, p = np.nonzero(visits)
                        found += [(rows[r], 2 * c + kind, False) for r, c in zip(a.tolist(), p.tolist()) if 2 * c + kind != home[r]]
                for i, cell, at_home in found:
                    for name, value in zip(out, (f"{key[0]}:{key[1]}", cell, at_home, ids[i], packed[i])):
                        out[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out["label"], pa.string()), pa.array(out["cell"], pa.int32()), pa.array(out["home"], pa.bool_()),
                                              pa.array(out["id"], pa.int64()), pa.array(out["unit"], pa.binary())], names=list(out))

    placed = written(units.select("id", "label", "unit").mapInArrow(place, "label string, cell int, home boolean, id long, unit binary"), "placed")
    sizes = placed.groupBy("label", "cell").agg(
        F.count(F.when(F.col("home"), 1)).alias("n"), F.count(F.when(~F.col("home"), 1)).alias("guests"), F.min(F.when(F.col("home"), F.col("id"))).alias("least"))
    sizes = written(sizes.filter("n > 0").select(
        "label", "cell", "n", "least", F.ceil(F.col("n") / cell_rows).cast("int").alias("cuts"),
        F.greatest(F.lit(1), F.ceil((F.col("guests") + F.when(F.col("n") > cell_rows, F.col("n")).otherwise(0)) / (8 * cell_rows))).cast("int").alias("hosts")), "cells")
    # A task is a slice of the residents and a share of the guests. Residents of an outer cell are guests of its other
    # slices; those of a ball need not be.
    cells = placed.join(sizes.select("label", "cell", "cuts", "hosts", "least"), ["label", "cell"])
    mark = F.xxhash64("id", "unit")
    own, share = F.pmod(mark, "cuts").cast("int"), F.pmod(F.shiftrightunsigned(mark, 20), "hosts").cast("int")
    slices, shares = F.sequence(F.lit(0), F.col("cuts") - 1), F.sequence(F.lit(0), F.col("hosts") - 1)
    task = F.when(F.col("home"), F.transform(shares, lambda h: F.struct(own.alias("slice"), h.alias("host"), F.lit(True).alias("home")))).otherwise(F.array())
    guest = F.filter(slices, lambda k: ~F.col("home") | ((F.col("cell") % 2 == 1) & (k != own)))
    task = F.concat(task, F.transform(guest, lambda k: F.struct(k.alias("slice"), share.alias("host"), F.lit(False).alias("home"))))
    cut = cells.select("label", "cell", "least", F.explode(task).alias("task"), "id", "unit").select("label", "cell", "task.slice", "task.host", "least", "task.home", "id", "unit")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, task = None, None
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[:4] != key:
                    if task is not None:
                        yield task.result()
                    key, task = row[:4], CellTask(row[1] % 2 == 0, row[3] == 0, row[4], cosine)
                task.add(*row[5:])
        if task is not None:
            yield task.result()

    tasks = cut.repartition("label", "cell", "slice", "host").sortWithinPartitions("label", "cell", "slice", "host", F.col("home").desc())
    found = written(tasks.mapInArrow(join, "a long, b long, n long"), "found")
    in_ball = placed.filter("home and cell % 2 = 0").join(sizes.select("label", "cell", "n"), ["label", "cell"]).select(F.col("id").alias("a"), (F.col("n") - 1).alias("n"))
    counts = union_all([found.filter("b is null").select("a", "n"), in_ball]).groupBy("a").agg(F.sum("n").alias("n_links"))
    parts = connected_components(found.filter("b is not null"))
    ids = vectors.select(F.col(id_col).alias("_row"), F.col(id_col).cast("long").alias("_id"))
    out = ids.join(counts, ids["_id"] == counts["a"], "left").join(parts, ids["_id"] == parts["node"], "left")
    component = F.coalesce("component", "_id")
    return out.select(F.col("_row").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(component == F.col("_id"), F.lit(True)).alias("kept"))


def digest(vectors: DataFrame) -> DataFrame:
    return near_vectors(vectors)


ORACLE = f"""
WITH RECURSIVE u AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {MIN_COSINE}),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS least FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(least, vec_id)) AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
