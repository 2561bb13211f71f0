"""Query-wise boosted ranking (LambdaMART) as Spark passes over packed queries.

A query's candidates are one row (a top-K pool, so its size is bounded and checked); queries are bundled, one bundle per
task, as arrays of bin codes, labels and scores. A pass per tree level adds up histograms with numpy; only their sum
(models x nodes x features x bins) reaches the driver, which picks the splits. All models grow in the same passes: every
fold and the final model, of every recipe (`Spec`) over every candidate table. Of two sister nodes only the lighter one is
counted, the other is the rest of its parent; leaves come from the sums of the last split, so a tree of depth d is d passes.
While the judged rows of a table fit one task (`ALONE_BUNDLES`), passes are mostly fixed cost: then every model gets the
bundles of its table and grows in a task of its own, all of them in one job and by the same steps.

Gradients are made once per tree and stay beside the scores with the executors that made them, in memory or on disk. A
lost one is made again from the bundle before it, and every `KEEP_TREES` trees the bundles are written to the shared
folder, so at most that many trees are replayed. Rows and columns drawn for a tree depend on seed, tree and row alone. A
missing feature has its own bin and each split learns where to send it."""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, Window, functions as F

from ranklab.operators.ordering import global_rank
from ranklab.session import checkpoint, shared_folder, union_all

FINAL = -1
#: Trees between two written states, and judged rows of a bundle.
KEEP_TREES = 25
BUNDLE_ROWS = 200_000
#: Bundles of a table whose models still grow in a task each: 4 million judged rows of about 100 bytes.
ALONE_BUNDLES = 20
#: Candidates whose pairs are taken at once, so that they stay in the processor's cache; combinations of codes counted at once.
PAIR_ROWS = 1 << 15
JOINT_CELLS = 1 << 16
#: Candidates that are scored at once; those whose codes stay in the processor's cache, and combinations of codes a tree has masks for.
SCORE_ROWS = 50_000
MASK_ROWS = 1 << 13
MASK_CELLS = 1 << 11


@dataclass(frozen=True)
class Params:
    """The full size is the default; `rows` and `columns` are the shares drawn for each tree."""
    trees: int = 300
    depth: int = 4
    rate: float = 0.05
    reg_lambda: float = 1.0
    min_child_weight: float = 2.0
    rows: float = 0.9
    columns: float = 0.9
    bins: int = 32
    linear_gain: bool = False
    max_group: int = 2_000
    seed: int = 7


@dataclass(frozen=True)
class Spec:
    """A recipe: which candidate table, which of its features, which gain in the loss."""
    table: str
    features: tuple[str, ...]
    linear_gain: bool = False


@dataclass
class Model:
    """Trees per fold: each a dict of node -> (feature, bin, missing_left) or leaf value, nodes numbered as a heap."""
    features: tuple[str, ...]
    edges: list[list[float]]
    trees: dict[int, list[dict]] = field(default_factory=dict)
    gains: dict[int, dict[int, list[float]]] = field(default_factory=dict)

    def importances(self) -> dict[str, float]:
        """Mean over the fold models of each feature's mean gain per split, as a share of all."""
        total = np.zeros(len(self.features))
        folds = [f for f in self.gains if f != FINAL] or list(self.gains)
        for f in folds:
            mean = np.array([np.mean(self.gains[f].get(i, [0.0])) for i in range(len(self.features))])
            total += mean / mean.sum() if mean.sum() > 0 else mean
        return dict(zip(self.features, (total / max(len(folds), 1)).tolist()))

    def dumps(self) -> str:
        plain = {str(f): [{"splits": {str(k): list(v) for k, v in t["splits"].items()}, "leaves": {str(k): v for k, v in t["leaves"].items()}}
                          for t in ts] for f, ts in self.trees.items()}
        return json.dumps({"features": list(self.features), "edges": self.edges, "trees": plain})

    @staticmethod
    def loads(text: str) -> "Model":
        raw = json.loads(text)
        trees = {int(f): [{"splits": {int(k): tuple(v) for k, v in t["splits"].items()}, "leaves": {int(k): v for k, v in t["leaves"].items()}}
                          for t in ts] for f, ts in raw["trees"].items()}
        return Model(tuple(raw["features"]), raw["edges"], trees)


def group_kfold(queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, fold): queries dealt to k folds in id order; a query is never split."""
    placed = global_rank(queries.select("query_id").distinct(), "query_id", "position")
    return placed.select("query_id", F.pmod(F.col("position") - 1, F.lit(k)).cast("int").alias("fold"))


def bin_edges(rows: DataFrame, features: Sequence[str], bins: int) -> list[list[float]]:
    """Quantile cut points per feature, from Spark's approximate quantiles: features x bins numbers."""
    probs = [i / bins for i in range(1, bins)]
    return [sorted(set(e)) for e in rows.approxQuantile(list(features), probs, 1.0 / (4 * bins))]


def pack_queries(rows: DataFrame, folds: DataFrame, features: Sequence[str], max_group: int) -> DataFrame:
    """(query_id, fold, docs, labels, keys, x): one row per query; label -1 = unjudged. A query beyond `max_group`
    candidates is an error, because a pool is a top-K list."""
    entry = F.struct(F.col("doc_id"), F.xxhash64("query_id", "doc_id").alias("key"), F.coalesce("label", F.lit(-1)).cast("int").alias("label"),
                     F.array(*[F.col(f).cast("double") for f in features]).alias("x"))
    sizes = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    guarded = rows.join(sizes, "query_id").where(F.when(
        F.col("n") > max_group, F.raise_error(F.lit("a query has more candidates than a pool may hold")).cast("boolean")).otherwise(F.lit(True)))
    packed = guarded.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("rows")).join(folds, "query_id")
    return packed.select("query_id", "fold", F.transform("rows", lambda r: r["doc_id"]).alias("docs"),
                         F.transform("rows", lambda r: r["label"]).alias("labels"), F.transform("rows", lambda r: r["key"]).alias("keys"), F.flatten(F.transform("rows", lambda r: r["x"])).alias("x"))


def _codes(x: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    """Bin codes; 0 is the missing bin."""
    out = np.zeros(x.shape, dtype=np.uint8)
    for j, cut in enumerate(edges):
        seen = ~np.isnan(x[:, j])
        out[seen, j] = 1 + np.searchsorted(np.asarray(cut), x[seen, j], side="left")
    return out


@dataclass
class Flat:
    """A tree as arrays over its nodes: feature (-1: none), last bin to the left, where missing goes, value."""
    feature: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray

    @staticmethod
    def of(tree: dict, depth: int) -> "Flat":
        n = 1 << (depth + 1)
        flat = Flat(np.full(n, -1), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool), np.zeros(n))
        for node, (j, cut, missing_left) in tree["splits"].items():
            flat.feature[node], flat.cut[node], flat.missing_left[node] = j, cut, missing_left
        for node, value in tree["leaves"].items():
            flat.value[node] = value
        return flat

    def walk(self, codes: np.ndarray) -> np.ndarray:
        """The node every row ends in."""
        node = np.ones(len(codes), dtype=np.int64)
        for _ in range(len(self.feature).bit_length() - 2):
            node = self.down(codes, node)
        return node

    def down(self, codes: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The nodes one level below `node`; a row in a leaf stays."""
        j = self.feature[node]
        c = codes[np.arange(len(codes)), j]
        left = np.where(c == 0, self.missing_left[node], c <= self.cut[node])
        return np.where(j >= 0, 2 * node + 1 - left, node)


def _depth(tree: dict) -> int:
    return max([*tree["splits"], *tree["leaves"], 1]).bit_length() - 1


def _joint(cells: Sequence[int], most: int) -> list[list[int]]:
    """Columns put together so that no group has more than `most` combinations of their codes; a column of more stands alone."""
    groups: list[list[int]] = []
    for j in sorted(range(len(cells)), key=lambda j: (-cells[j], j)):
        for group in groups:
            if cells[j] * int(np.prod([cells[i] for i in group])) <= most:
                group.append(j)
                break
        else:
            groups.append([j])
    return groups


def _joint_codes(columns: np.ndarray, cells: Sequence[int], group: Sequence[int]) -> np.ndarray:
    """One code for the combination of the codes of a group's columns; `columns` is (columns, rows)."""
    out = columns[group[0]].astype(np.int64)
    for j in group[1:]:
        out = out * cells[j] + columns[j]
    return out


#: Lowest bit set of every mask of 16 bits.
_LOWEST = np.array([(m & -m).bit_length() - 1 for m in range(1 << 16)]).clip(0).astype(np.uint8)


class _Forest:
    """Trees of at most 16 leaves as masks. Every split forbids the leaves of the side a row does not take, so a column's
    code says which leaves its splits leave open, and the one that all columns leave open is the row's leaf. Columns are read
    a group at a time, by joint codes: what a tree costs is a lookup for each group, whatever its depth."""

    def __init__(self, trees: list[Flat], cells: Sequence[int]):
        self.trees, self.cells, self.groups = trees, cells, _joint(cells, MASK_CELLS)
        self.masks = [self._masks(t) for t in trees] if all(len(t.feature) <= 32 for t in trees) else None

    def _masks(self, tree: Flat) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
        """([(group, mask by joint code)], value by leaf)."""
        n_leaves, value = len(tree.feature) // 2, np.zeros(16)
        depth, open_ = n_leaves.bit_length() - 1, {}

        def leaves(node: int) -> tuple[int, int]:
            below = depth - (node.bit_length() - 1)
            return (node << below) - n_leaves, ((node + 1) << below) - n_leaves

        bits = lambda node: ((1 << leaves(node)[1]) - 1) ^ ((1 << leaves(node)[0]) - 1)
        todo = [1]
        while todo:
            node = todo.pop()
            j = int(tree.feature[node])
            if j < 0:
                value[slice(*leaves(node))] = tree.value[node]
                continue
            left = np.arange(self.cells[j]) <= tree.cut[node]
            left[0] = tree.missing_left[node]
            mask = open_.setdefault(j, np.full(self.cells[j], 0xFFFF, dtype=np.uint16))
            mask &= np.where(left, 0xFFFF ^ bits(2 * node + 1), 0xFFFF ^ bits(2 * node)).astype(np.uint16)
            todo += [2 * node, 2 * node + 1]
        out = []
        for i, group in enumerate(self.groups):
            if any(j in open_ for j in group):
                joint = np.full(1, 0xFFFF, dtype=np.uint16)
                for j in group:
                    joint = (joint[:, None] & open_.get(j, np.full(self.cells[j], 0xFFFF, dtype=np.uint16))).ravel()
                out.append((i, joint))
        return out, value

    def score(self, codes: np.ndarray) -> np.ndarray:
        score = np.zeros(len(codes))
        if self.masks is None:
            for tree in self.trees:
                score += tree.value[tree.walk(codes)]
            return score
        for low in range(0, len(codes), MASK_ROWS):
            columns = np.ascontiguousarray(codes[low:low + MASK_ROWS].T)
            joint = [_joint_codes(columns, self.cells, g) for g in self.groups]
            some = score[low:low + MASK_ROWS]
            for masks, value in self.masks:
                if masks:
                    leaf = np.take(masks[0][1], joint[masks[0][0]])
                    for i, mask in masks[1:]:
                        leaf &= np.take(mask, joint[i])
                    some += np.take(value, np.take(_LOWEST, leaf))
                else:
                    some += value[0]
        return score


def _gains(labels: np.ndarray, linear: bool) -> np.ndarray:
    return labels.astype(float) if linear else np.power(2.0, labels) - 1.0


def _ideal(gain: np.ndarray) -> np.ndarray:
    """DCG of the best order of every query; `gain` is (candidates, queries)."""
    return (-np.sort(-gain, axis=0) / np.log2(np.arange(2.0, len(gain) + 2))[:, None]).sum(axis=0)


def _pair_sums(gain: np.ndarray, best: np.ndarray, s: np.ndarray, first: np.ndarray, second: np.ndarray) -> None:
    """Both derivatives of queries of one length into `first` and `second`; all but `best` are (candidates, queries), so
    that a step of the loop meets one candidate with all after it, in all queries at once."""
    n = len(s)
    small = np.int8 if n <= 127 else np.int16
    rank = np.zeros(s.shape, dtype=small)
    for a in range(n - 1):                             # of equal scores the earlier candidate ranks higher
        ahead = (s[a] >= s[a + 1:]).view(np.int8)
        rank[a + 1:] += ahead
        rank[a] += n - 1 - a - ahead.sum(axis=0, dtype=small)
    discount = np.take(1.0 / np.log2(np.arange(2.0, n + 2)), rank)
    first[:], second[:] = 0.0, 0.0
    room = np.empty((3, max(n - 1, 0), s.shape[1]))
    for a in range(n - 1):
        one, rho, other = room[:, :n - 1 - a]
        np.subtract(gain[a], gain[a + 1:], out=one)
        np.sign(one, out=other)
        np.subtract(s[a], s[a + 1:], out=rho)
        rho *= other
        np.exp(np.minimum(rho, 50.0, out=rho), out=rho)
        np.divide(1.0, np.add(rho, 1.0, out=rho), out=rho)
        one *= np.abs(np.subtract(discount[a], discount[a + 1:], out=other), out=other)
        one *= rho                                     # signed: below 0 if the later candidate has the larger gain
        first[a] -= one.sum(axis=0)
        first[a + 1:] += one
        np.abs(one, out=one)
        one *= np.subtract(1.0, rho, out=rho)
        second[a] += one.sum(axis=0)
        second[a + 1:] += one
    first /= best
    second /= best


def _lambdas(labels: np.ndarray, score: np.ndarray, linear: bool) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives, per model and row of `score` (models x rows, or models x queries x rows), of the
    pairwise loss weighted by the NDCG change of swapping the pair. Queries of one length share the calls to numpy."""
    shape, n = score.shape, labels.shape[-1]
    gain = np.ascontiguousarray(_gains(labels.reshape(-1, n), linear).T)
    score = score.reshape(len(score), -1, n)
    first, second = np.zeros(score.shape), np.zeros(score.shape)
    useful = np.flatnonzero(gain.min(axis=0) < gain.max(axis=0))
    at_once = max(1, PAIR_ROWS // n)
    for start in range(0, len(useful), at_once):
        q = useful[start:start + at_once]
        best = _ideal(gain[:, q])
        for m in range(len(score)):
            one, two = np.empty((2, n, len(q)))
            _pair_sums(gain[:, q], best, np.ascontiguousarray(score[m, q].T), one, two)
            first[m, q], second[m, q] = one.T, two.T
    return first.reshape(shape), second.reshape(shape)


def _drawn(keys: np.ndarray, seed: int, tree: int, share: float) -> np.ndarray:
    """Rows drawn for a tree: a hash of row, seed and tree below the share."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64) + np.uint64((seed * 1_000_003 + tree + 1) % (1 << 63)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)) * 2.0 ** -53 < share


def _flat(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """The values of a list column, one list after another; a missing double is NaN."""
    return batch.column(column).flatten().to_numpy(zero_copy_only=False)


def _sizes(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return pc.list_value_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64)


@dataclass(frozen=True)
class _Grown:
    """One model in training: recipe number, table number, the columns it may look at, and the fold it must not see."""
    spec: int
    table: int
    columns: tuple[int, ...]
    fold: int
    linear: bool


def _bundles(packed: DataFrame, edges: list[list[list[float]]]) -> DataFrame:
    """(part, bundle): one row per task and table, the judged candidates of its queries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        for batch in batches:
            part = batch.column("part").to_numpy()
            for p in np.unique(part).tolist():
                some = batch.filter(pa.array(part == p))
                labels, sizes = _flat(some, "labels"), _sizes(some, "labels")
                judged = labels >= 0
                counts = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[judged], minlength=len(sizes))
                x = _flat(some, "x").astype(float).reshape(-1, len(edges[p]))[judged]
                parts.setdefault(p, []).append((labels[judged].astype(np.int8), _codes(x, edges[p]), _flat(some, "keys")[judged], counts[counts > 0],
                                                some.column("fold").to_numpy()[counts > 0]))
        for p, rows in sorted(parts.items()):
            labels, codes, keys, counts, folds = (np.concatenate(c) for c in zip(*rows))
            if len(labels):
                bundle = {p: {"labels": labels, "codes": codes, "keys": keys, "stops": np.cumsum(counts), "folds": folds}}
                yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "bundle": pa.array([pickle.dumps(bundle, protocol=5)], pa.binary())})

    return packed.mapInArrow(run, "part int, bundle binary")


def _columns(b: dict, model: _Grown) -> np.ndarray:
    """The codes of the columns that a model may look at."""
    every = model.columns == tuple(range(b["codes"].shape[1]))
    return b["codes"] if every else b["codes"][:, model.columns]


def _gradients(b: dict, mine: list[_Grown], scores: np.ndarray, params: Params, tree: int) -> tuple[np.ndarray, np.ndarray]:
    """Both derivatives, per model of `mine` and row: 0 in the fold a model must not see and in rows not drawn."""
    g, h = np.zeros(scores.shape), np.zeros(scores.shape)
    sizes = np.diff(b["stops"], prepend=0)
    unseen = np.array([m.fold for m in mine])[:, None] != b["folds"]
    for n in np.unique(sizes):
        these = np.flatnonzero(sizes == n)
        rows = (b["stops"][these] - n)[:, None] + np.arange(n)
        for linear in (False, True):
            at = np.array([k for k, m in enumerate(mine) if m.linear == linear], dtype=np.int64)
            if len(at):
                place = at[:, None], rows.ravel()
                used = np.repeat(unseen[at][:, these], n, axis=1)
                one, two = _lambdas(b["labels"][rows], scores[place].reshape(len(at), *rows.shape), linear)
                g[place], h[place] = one.reshape(used.shape) * used, two.reshape(used.shape) * used
    left_out = ~_drawn(b["keys"], params.seed, tree, params.rows)
    g[:, left_out] = h[:, left_out] = 0.0
    return g, h


def _step(bundle: dict, models: list[_Grown], trees: list[dict] | None, params: Params, tree: int) -> dict:
    """`bundle` with `trees`, one per model, added to its scores (0 at first), and with the gradients of the next tree."""
    out = {}
    for part, b in bundle.items():
        mine = [i for i, m in enumerate(models) if m.table == part]
        scores = b["scores"].copy() if "scores" in b else np.zeros((len(mine), len(b["labels"])))
        if trees is not None:
            for k, i in enumerate(mine):
                flat = Flat.of(trees[i], params.depth)
                scores[k] += flat.value[flat.walk(_columns(b, models[i]))]
        g, h = _gradients(b, [models[i] for i in mine], scores, params, tree)
        out[part] = b | {"scores": scores, "g": g, "h": h}
    return out


def _node_sums(codes: np.ndarray, g: np.ndarray, h: np.ndarray, node: np.ndarray, wanted: list[int], params: Params) -> list[np.ndarray]:
    """(2, features, bins) of each wanted node: sums of both derivatives over its rows."""
    n_codes, width = params.bins + 1, codes.shape[1]
    place = np.full(1 << (params.depth + 1), -1)
    place[wanted] = np.arange(len(wanted))
    node = place[node]
    rows = np.flatnonzero((node >= 0) & (h != 0))
    base, weights = node[rows] * n_codes, (g[rows], h[rows])
    sums = np.empty((len(wanted), 2, width, n_codes))
    for j in range(width):
        at = base + codes[rows, j]
        for d in range(2):
            sums[:, d, j] = np.bincount(at, weights[d], len(wanted) * n_codes).reshape(-1, n_codes)
    return list(sums)


def _histograms(bundle: dict, models: list[_Grown], growing: list[dict], wanted: list[list[int]], params: Params) -> dict[tuple[int, int], np.ndarray]:
    """(model, node) -> (2, features, bins): sums of both derivatives over the rows now in the node."""
    out = {}
    for part, b in bundle.items():
        for k, i in enumerate(i for i, m in enumerate(models) if m.table == part):
            if wanted[i]:
                codes = _columns(b, models[i])
                node = Flat.of(growing[i], params.depth).walk(codes)
                out |= {(i, n): x for n, x in zip(wanted[i], _node_sums(codes, b["g"][k], b["h"][k], node, wanted[i], params))}
    return out


def _summed(parts: RDD, tasks: int) -> dict[tuple[int, int], np.ndarray]:
    """Histograms of all tasks added up: by the driver if they are few, else first by executors."""
    def add(a: dict, b: dict) -> dict:
        for key, value in b.items():
            a[key] = a[key] + value if key in a else value
        return a

    if tasks > 64:
        return parts.treeReduce(add, depth=2)
    total: dict = {}
    for part in parts.collect():
        add(total, part)
    return total


def _best_split(hist: np.ndarray, allowed: np.ndarray, params: Params) -> tuple[float, tuple[int, int, bool], np.ndarray] | None:
    """(gain, (feature, bin, missing_left), left sums) of the split of a node with the largest gain; `hist` is (2,
    features, bins), bin 0 = missing."""
    total = hist[:, 0].sum(axis=1)
    value = lambda s: s[0] * s[0] / (s[1] + params.reg_lambda)
    left = np.cumsum(hist[:, :, 1:], axis=2)[:, :, None, :] + np.stack((hist[:, :, 0], np.zeros_like(hist[:, :, 0])), axis=2)[..., None]
    right = total[:, None, None, None] - left
    # Rounded, so that sums added up in another order give the same split of several that are equally good.
    gain = np.round(value(left) + value(right) - value(total), 9)
    gain[(left[1] < params.min_child_weight) | (right[1] < params.min_child_weight)] = -np.inf
    gain[~allowed] = -np.inf
    gain[:, :, -1] = -np.inf
    at = int(np.argmax(gain))
    j, miss, cut = np.unravel_index(at, gain.shape)
    if not gain[j, miss, cut] > 0:
        return None
    return float(gain[j, miss, cut]), (int(j), int(cut) + 1, bool(miss == 0)), left[:, j, miss, cut]


def _grow(count: Callable[[list[dict], list[list[int]]], dict[tuple[int, int], np.ndarray]], models: list[_Grown], params: Params, tree: int,
          found: list[dict[int, list[float]]]) -> list[dict]:
    """One tree for every model; `count(growing, wanted)` gives the histograms of all rows."""
    growing = [{"splits": {}, "leaves": {}} for _ in models]
    draws = [np.random.default_rng((params.seed, tree, m.spec, m.fold + 1)) for m in models]
    allowed = []
    for m, draw in zip(models, draws):
        n = len(m.columns)
        mask = np.zeros(n, dtype=bool)
        mask[draw.permutation(n)[:max(1, round(params.columns * n))]] = True
        allowed.append(mask)
    leaf = lambda s: float(-params.rate * s[0] / (s[1] + params.reg_lambda))
    open_nodes = [{1: None} for _ in models]            # node -> (parent's histogram, sister counted instead) or None
    for level in range(params.depth):
        wanted = [[n for n, rest in nodes.items() if rest is None] for nodes in open_nodes]
        if not any(wanted):
            break
        sums = count(growing, wanted)
        coming = [{} for _ in models]
        for i, nodes in enumerate(open_nodes):
            empty = np.zeros((2, len(models[i].columns), params.bins + 1))
            for node in sorted(nodes, key=lambda n: nodes[n] is not None):
                hist = sums.get((i, node), empty) if nodes[node] is None else nodes[node][0] - sums.get((i, nodes[node][1]), empty)
                split = _best_split(hist, allowed[i], params)
                if split is None:
                    growing[i]["leaves"][node] = leaf(hist[:, 0].sum(axis=1))
                    continue
                gain, growing[i]["splits"][node], left = split
                found[i].setdefault(growing[i]["splits"][node][0], []).append(gain)
                right = hist[:, 0].sum(axis=1) - left
                if level + 1 == params.depth:
                    growing[i]["leaves"] |= {2 * node: leaf(left), 2 * node + 1: leaf(right)}
                    continue
                light, heavy = (2 * node, 2 * node + 1) if left[1] <= right[1] else (2 * node + 1, 2 * node)
                coming[i] |= {light: None, heavy: (hist, light)}
        open_nodes = coming
    return growing


def _joined(bundles: list[dict]) -> dict:
    """Several bundles of one table as one."""
    part, = bundles[0]
    rows = [b[part] for b in bundles]
    ends = np.cumsum([len(r["labels"]) for r in rows])
    out = {c: np.concatenate([r[c] for r in rows]) for c in ("labels", "codes", "keys", "folds")}
    return {part: out | {"stops": np.concatenate([r["stops"] + end - len(r["labels"]) for r, end in zip(rows, ends)])}}


class _Rows:
    """What one model may see of a table, laid out for growing it: the queries outside its fold that have pairs (others have
    no gradient), in blocks of one length with the candidates of a place side by side; codes by column, and joint codes of
    columns, whose sums give those of each column."""

    def __init__(self, b: dict, model: _Grown, params: Params):
        sizes = np.diff(b["stops"], prepend=0)
        starts = b["stops"] - sizes
        gains, order, self.blocks = _gains(b["labels"], model.linear), [], []
        low = 0
        for n in np.unique(sizes[b["folds"] != model.fold]):
            queries = np.flatnonzero((sizes == n) & (b["folds"] != model.fold))
            at_once = max(1, PAIR_ROWS // n)
            for start in range(0, len(queries), at_once):
                rows = starts[queries[start:start + at_once]] + np.arange(n)[:, None]
                gain = gains[rows]
                useful = gain.min(axis=0) < gain.max(axis=0)
                if useful.any():
                    rows, gain = rows[:, useful], np.ascontiguousarray(gain[:, useful])
                    order.append(rows.ravel())
                    self.blocks.append((slice(low, low + rows.size), gain, _ideal(gain)))
                    low += rows.size
        order = np.concatenate(order) if order else np.zeros(0, dtype=np.int64)
        self.keys = b["keys"][order]
        self.columns = np.ascontiguousarray(b["codes"][order][:, list(model.columns)].T)
        self.cells = [params.bins + 1] * len(model.columns)
        if len(order):
            self.cells = [int(c) + 1 for c in self.columns.max(axis=1)]
        self.groups = _joint(self.cells, max(params.bins + 1, min(JOINT_CELLS, len(order) // 8)))
        self.joint = [_joint_codes(self.columns, self.cells, g).astype(np.uint16) for g in self.groups]
        self.g, self.h, self.score = (np.zeros(len(order)) for _ in range(3))
        self.params = params

    def gradients(self, tree: int) -> None:
        for rows, gain, best in self.blocks:
            shape = gain.shape
            g, h = self.g[rows], self.h[rows]
            _pair_sums(gain, best, self.score[rows].reshape(shape), g.reshape(shape), h.reshape(shape))
            left_out = ~_drawn(self.keys[rows], self.params.seed, tree, self.params.rows)
            g[left_out] = h[left_out] = 0.0
        self.nodes = {1: None}                         # open node -> its rows (None: all)

    def left(self, node: int, split: tuple[int, int, bool]) -> np.ndarray:
        j, cut, missing_left = split
        goes = np.arange(256) <= cut
        goes[0] = missing_left
        codes = self.columns[j]
        return np.take(goes, codes if self.nodes[node] is None else np.take(codes, self.nodes[node]))

    def down(self, splits: dict[int, tuple[int, int, bool]]) -> None:
        """Rows of open nodes that have been split go to their children."""
        for node in [n for n in self.nodes if n in splits]:
            left = self.left(node, splits[node])
            rows = self.nodes.pop(node)
            for child, side in ((2 * node, left), (2 * node + 1, ~left)):
                self.nodes[child] = np.flatnonzero(side) if rows is None else np.compress(side, rows)

    def sums(self, node: int) -> np.ndarray:
        """(2, columns, bins): both derivatives by column and code over the rows of an open node."""
        rows = self.nodes[node]
        out = np.zeros((2, len(self.columns), self.params.bins + 1))
        weights = (self.g, self.h) if rows is None else (np.take(self.g, rows), np.take(self.h, rows))
        for group, joint in zip(self.groups, self.joint):
            at = (joint if rows is None else np.take(joint, rows)).astype(np.intp)
            shape = [self.cells[j] for j in group]
            for d in range(2):
                rest = np.bincount(at, weights[d], int(np.prod(shape))).reshape(shape)
                for j in group[::-1]:                  # the last column by itself, then it is summed away
                    out[d, j, :self.cells[j]] = rest.reshape(-1, self.cells[j]).sum(axis=0)
                    rest = rest.sum(axis=-1)
        return out

    def add(self, tree: dict) -> None:
        """A tree's values to the scores of its rows, whose nodes are those before the last splits."""
        for node, rows in self.nodes.items():
            if node in tree["splits"]:
                value = np.where(self.left(node, tree["splits"][node]), tree["leaves"][2 * node], tree["leaves"][2 * node + 1])
            else:
                value = tree["leaves"][node]
            if rows is None:
                self.score += value
            else:
                self.score[rows] += value


def _grown_alone(b: dict, model: _Grown, params: Params) -> tuple[list[dict], dict[int, list[float]]]:
    """(trees, gains) of one model over the rows of one bundle. Rows keep their node from level to level, so that a tree
    is walked once."""
    rows, found, trees = _Rows(b, model, params), [{}], []

    def count(growing: list[dict], wanted: list[list[int]]) -> dict[tuple[int, int], np.ndarray]:
        rows.down(growing[0]["splits"])
        return {(0, n): rows.sums(n) for n in wanted[0]}

    for n in range(params.trees):
        rows.gradients(n)
        trees += _grow(count, [model], params, n, found)
        rows.add(trees[-1])
    return trees, found[0]


def _grown_apart(bundles: RDD, models: list[_Grown], judged: dict[int, int], params: Params) -> tuple[list[list[dict]], list[dict[int, list[float]]]]:
    """(trees, gains) of every model, each model grown in its own task; those with most to count come first, so that none of
    them is left over at the end. `judged` has the judged rows of every table."""
    def grow(items: Iterator[tuple[int, bytes]]) -> Iterator[tuple[int, list[dict], dict[int, list[float]]]]:
        parts: dict[int, list[bytes]] = {}
        for i, part in items:
            parts.setdefault(i, []).append(part)
        for i in sorted(parts):
            bundle, = _joined([pickle.loads(p) for p in sorted(parts.pop(i))]).values()
            yield i, *_grown_alone(bundle, models[i], params)

    order = sorted(range(len(models)), key=lambda i: -judged.get(models[i].table, 0) * len(models[i].columns))
    task = {i: place for place, i in enumerate(order)}
    copies = bundles.flatMap(lambda r: [(i, bytes(r.bundle)) for i, m in enumerate(models) if m.table == r.part])
    done = {i: (trees, found) for i, trees, found in copies.partitionBy(len(models), task.__getitem__).mapPartitions(grow).collect()}
    # A table without judged rows has no bundle; its models are made of empty trees, as passes over nothing make them.
    for i in set(range(len(models))) - set(done):
        found: list[dict[int, list[float]]] = [{}]
        done[i] = [_grow(lambda growing, wanted: {}, [models[i]], params, n, found)[0] for n in range(params.trees)], found[0]
    return [done[i][0] for i in range(len(models))], [done[i][1] for i in range(len(models))]


def _grown_together(bundles: RDD, tasks: int, models: list[_Grown], params: Params) -> tuple[list[list[dict]], list[dict[int, list[float]]]]:
    """(trees, gains) of every model, all grown in common passes over the bundles."""
    state = bundles.map(lambda r: pickle.loads(bytes(r.bundle)))
    found: list[dict[int, list[float]]] = [{} for _ in models]
    trees: list[dict] | None = None
    grown: list[list[dict]] = []
    for n in range(params.trees):
        before, state = state, state.map(lambda b, t=trees, n=n: _step(b, models, t, params, n)).persist(StorageLevel.MEMORY_AND_DISK)
        if n and n % KEEP_TREES == 0:
            state.checkpoint()
        trees = _grow(lambda growing, wanted, s=state: _summed(s.map(lambda b: _histograms(b, models, growing, wanted, params)), tasks), models, params, n, found)
        grown.append(trees)
        if n:
            before.unpersist()
    state.unpersist()
    return [[trees[i] for trees in grown] for i in range(len(models))], found


@dataclass(frozen=True)
class Packed:
    """A candidate table ready for training: its packed queries, written once, their features and the cut points of each."""
    queries: DataFrame
    features: tuple[str, ...]
    edges: list[list[float]]


def used_features(specs: dict[str, Spec], table: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(f for s in specs.values() if s.table == table for f in s.features))


def pack(rows: DataFrame, folds: DataFrame, features: Sequence[str], params: Params = Params()) -> Packed:
    return Packed(checkpoint(pack_queries(rows, folds, features, params.max_group)), tuple(features), bin_edges(rows, features, params.bins))


def grow_models(packed: dict[str, Packed], specs: dict[str, Spec], wanted: Sequence[tuple[str, int]], params: Params = Params()) -> dict[str, Model]:
    """The models (recipe, fold) of `wanted`. Draws depend on the recipe's place in `specs`, so a model is the same whichever
    others are grown with it; `packed` needs only the tables of the wanted recipes."""
    names = [n for n in packed if any(specs[r].table == n for r, _ in wanted)]
    models = [_Grown(list(specs).index(r), names.index(specs[r].table), tuple(packed[specs[r].table].features.index(f) for f in specs[r].features), fold, specs[r].linear_gain)
              for r, fold in wanted]
    out = {r: Model(specs[r].features, [packed[specs[r].table].edges[packed[specs[r].table].features.index(f)] for f in specs[r].features], {}, {}) for r, _ in wanted}

    both = union_all([packed[n].queries.select(F.lit(i).alias("part"), "query_id", "fold", "labels", "keys", "x") for i, n in enumerate(names)])
    judged = {r.part: r.n for r in both.groupBy("part").agg(F.sum(F.size(F.filter("labels", lambda v: v >= 0))).alias("n")).collect()}
    sc = both.sparkSession.sparkContext
    tasks = max(1, -(-sum(judged.values()) // BUNDLE_ROWS), min(sc.defaultParallelism, both.count()))
    shared_folder(both.sparkSession)                   # sets the folder that checkpoints go to
    bundles = checkpoint(_bundles(both.repartition(tasks, "query_id"), [packed[n].edges for n in names])).rdd
    if max(judged.values(), default=0) <= ALONE_BUNDLES * BUNDLE_ROWS:
        grown, found = _grown_apart(bundles, models, judged, params)
    else:
        grown, found = _grown_together(bundles, tasks, models, params)
    for (r, fold), trees, gains in zip(wanted, grown, found):
        out[r].trees[fold], out[r].gains[fold] = trees, gains
    return out


def fit_all(tables: dict[str, DataFrame], specs: dict[str, Spec], folds: DataFrame, params: Params = Params(), k: int = 5,
            with_final: bool = True) -> tuple[dict[str, Model], dict[str, DataFrame]]:
    """Train every recipe in `specs`, one model per fold (on the other folds' judged rows) and, if asked, one on all of
    them. Returns the models, and per table the packed candidates, written once."""
    packed = {n: pack(df, folds, used_features(specs, n), params) for n, df in tables.items()}
    models = grow_models(packed, specs, [(r, f) for r in specs for f in [*range(k), *([FINAL] if with_final else [])]], params)
    return models, {n: p.queries for n, p in packed.items()}


def fit(rows: DataFrame, folds: DataFrame, features: Sequence[str], params: Params = Params(), k: int = 5,
        with_final: bool = True) -> tuple[Model, DataFrame]:
    """One recipe over one table: its models and the packed candidates."""
    models, packed = fit_all({"rows": rows}, {"model": Spec("rows", tuple(features), params.linear_gain)}, folds, params, k, with_final)
    return models["model"], packed["rows"]


def score(packed: DataFrame, model: Model, columns: Sequence[str] | None = None) -> DataFrame:
    """(query_id, doc_id, fold, oof_score, final_score): every candidate by the model that never saw its query, and
    by the final model (NaN where there is no such model). `columns` names the packed features if the model has only some."""
    packed_cols = list(columns or model.features)
    take = [packed_cols.index(f) for f in model.features]
    width, edges, trees = len(packed_cols), model.edges, model.trees

    def scored(batch: pa.RecordBatch, forests: dict[int, _Forest]) -> pa.RecordBatch:
        sizes = _sizes(batch, "docs")
        codes = _codes(_flat(batch, "x").astype(float).reshape(-1, width)[:, take], edges)
        fold = np.repeat(batch.column("fold").to_numpy(), sizes)
        oof = np.full(len(codes), np.nan)
        for f in set(fold.tolist()) & set(forests):
            oof[fold == f] = forests[f].score(codes[fold == f])
        final = forests[FINAL].score(codes) if FINAL in forests else np.full(len(codes), np.nan)
        return pa.RecordBatch.from_pydict({"query_id": pa.array(np.repeat(batch.column("query_id").to_numpy(), sizes), pa.int64()),
                                           "doc_id": pa.array(_flat(batch, "docs"), pa.int64()), "fold": pa.array(fold, pa.int32()),
                                           "oof_score": pa.array(oof), "final_score": pa.array(final)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [len(cut) + 2 for cut in edges]
        forests = {f: _Forest([Flat.of(t, _depth(t)) for t in ts], cells) for f, ts in trees.items()}
        for batch in batches:
            ends, low = np.cumsum(_sizes(batch, "docs")), 0
            while low < len(ends):
                held = ends[low - 1] if low else 0
                high = max(low + 1, int(np.searchsorted(ends, held + SCORE_ROWS, side="right")))
                yield scored(batch.slice(low, high - low), forests)
                low = high

    # Candidates are few bytes and much work: left to the size of their files, one task would score them all.
    tasks = max(packed.sparkSession.sparkContext.defaultParallelism, int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = packed.select("query_id", "fold", "docs", "labels", "x").repartition(tasks, "query_id")
    return spread.mapInArrow(run, "query_id long, doc_id long, fold int, oof_score double, final_score double")


def scores_of(models: dict[str, Model], packed: dict[str, DataFrame], specs: dict[str, Spec]) -> dict[str, DataFrame]:
    """Scores of every recipe of `fit_all`."""
    return {n: score(packed[s.table], models[n], used_features(specs, s.table)) for n, s in specs.items()}


def ltr_oof(rows: DataFrame, features: Sequence[str], params: Params = Params(), k: int = 5, with_final: bool = False) -> tuple[DataFrame, Model]:
    """Out-of-fold scores of all candidates and the models."""
    folds = group_kfold(rows, k)
    model, packed = fit(rows, folds, features, params, k, with_final)
    return score(packed, model), model


def fold_metrics(ranked: DataFrame, folds: DataFrame, gains: DataFrame, ks: Sequence[int] = (10,)) -> DataFrame:
    """Means of the metrics over the held-out queries of every fold: (fold, n_queries, metrics)."""
    from ranklab.operators.metrics import metric_columns, metrics_per_query
    per = metrics_per_query(ranked, gains, ks).join(folds.select("query_id", "fold"), "query_id")
    names = [c for c in metric_columns(per) if c != "fold"]
    return per.groupBy("fold").agg(F.count("*").alias("n_queries"), *[F.round(F.avg(c), 6).alias(c) for c in names])


def rank_by_score(scores: DataFrame, rows: DataFrame, column: str = "oof_score") -> DataFrame:
    """ranked(query_id, doc_id, score, rank); equal scores keep the fused order."""
    joined = scores.select("query_id", "doc_id", F.col(column).alias("score")).join(rows.select("query_id", "doc_id", "rrf_rank"), ["query_id", "doc_id"])
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "rrf_rank")
    return joined.select("query_id", "doc_id", "score", F.row_number().over(w).alias("rank"))


def export_scores(scores: DataFrame, column: str = "score") -> DataFrame:
    """(query_id, doc_id, semantic_score, rank): per query min-max to 0-100 (2 decimals; no spread divides by 1)."""
    edges = scores.groupBy("query_id").agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    span = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(F.lit(1.0))
    w = Window.partitionBy("query_id").orderBy(F.col(column).desc(), "doc_id")
    return scores.join(edges, "query_id").select(
        "query_id", "doc_id", F.round(F.lit(100.0) * (F.col(column) - F.col("lo")) / span, 2).alias("semantic_score"),
        F.row_number().over(w).alias("rank"))
