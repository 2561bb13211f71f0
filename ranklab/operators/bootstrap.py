"""Bootstrap intervals with one shared set of draws.

A draw table says how often position p is drawn in resample b. It depends only on (seed, purpose, n), so every
metric, system and relevance definition of an evaluation is resampled with the same draws and their differences
are paired. Draws are hashed on the executors; no random stream lives on the driver."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ranklab.functions.keys import key_to_long, numbered_keys, seeded_key
from ranklab.operators.ordering import global_rank
from ranklab.session import checkpoint, union_all

#: Report rows that share one join with the draws, and the most rows of a report.
COLUMNS = 48
MAX_COMBINATIONS = 5_000
#: Draws that one task makes.
TASK_DRAWS = 4_000_000
#: Units whose draws meet their values at once, if a block of values stays below so many bytes; draws that one row stands for.
BLOCK_UNITS = 4_096
BLOCK_BYTES = 1 << 25
RUN_DRAWS = 1 << 16


@dataclass(frozen=True)
class Draws:
    """The draws of `boot_draws`, not made yet: `placed(unit, position)` is written."""
    placed: DataFrame
    n: int
    n_boot: int
    seed: int
    purpose: str


def drawn_positions(units: DataFrame, unit_col: str, n_boot: int, seed: int = 7, purpose: str = "boot") -> Draws:
    """What `boot_draws` makes its rows from. `bootstrap_ci` of it gives the same intervals without a row for each draw."""
    ids = units.select(F.col(unit_col).alias("unit")).distinct()
    placed = checkpoint(global_rank(ids, "unit", "position"))
    return Draws(placed, placed.count(), n_boot, seed, purpose)


def boot_draws(units: DataFrame, unit_col: str, n_boot: int, seed: int = 7, purpose: str = "boot") -> DataFrame:
    """(boot, unit, times): n draws with replacement from the n units, for every resample.

    Units take positions 1..n by id; slot s of resample b draws position hash(seed, purpose, b, s) mod n."""
    d = drawn_positions(units, unit_col, n_boot, seed, purpose)
    n, placed = d.n, d.placed
    tasks = max(draw_tasks(n, n_boot), units.sparkSession.sparkContext.defaultParallelism)
    slots = units.sparkSession.range(1, n + 1, numPartitions=tasks).select(
        F.col("id").alias("slot"), F.explode(F.sequence(F.lit(1), F.lit(n_boot))).alias("boot"))
    drawn = slots.select("boot", (F.pmod(key_to_long(seeded_key(seed, purpose, "boot", "slot")), F.lit(n)) + 1)
                         .alias("position"))
    # The optimizer does not know that a slot becomes n_boot draws: only the positions may be the side held in memory.
    times = drawn.repartition(tasks, "position").groupBy("boot", "position").agg(F.count(F.lit(1)).alias("times"))
    return times.join(placed.hint("shuffle_hash"), "position").select("boot", "unit", "times")


def draw_tasks(n: int, n_boot: int) -> int:
    """Tasks that share the draws of n units."""
    return -(-n * n_boot // TASK_DRAWS)


def _counted(draws: Draws, width: int) -> DataFrame:
    """(block, boot, times): how often each of `width` neighbouring positions is drawn in a resample, as 16 bits a position.
    Slots of a resample are hashed one after another, so a task counts one resample at a time; one that is cut between tasks,
    or a position drawn more often than 16 bits can say, has several rows, which add up."""
    n, spark = draws.n, draws.placed.sparkSession
    runs = max(1, -(-n // RUN_DRAWS))
    tasks = min(draws.n_boot * runs, max(draw_tasks(n, draws.n_boot), spark.sparkContext.defaultParallelism))
    seed, purpose = draws.seed, draws.purpose

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, times = None, None

        def rows() -> Iterator[pa.RecordBatch]:
            counts = np.pad(times, (0, -n % width)).reshape(-1, width)
            while counts.any():
                blocks = np.flatnonzero(counts.any(axis=1))
                some = np.minimum(counts[blocks], 0xFFFF)
                yield pa.RecordBatch.from_pydict({"block": pa.array(blocks, pa.int32()), "boot": pa.array(np.full(len(blocks), now), pa.int32()),
                                                  "times": pa.array([x.astype("<u2").tobytes() for x in some], pa.binary())})
                counts[blocks] -= some

        for batch in batches:
            for i in batch.column("id").to_pylist():
                boot, first = i // runs + 1, i % runs * RUN_DRAWS + 1
                if boot != now:
                    if now is not None:
                        yield from rows()
                    now, times = boot, np.zeros(n, dtype=np.int64)
                keys = numbered_keys(f"{seed}|{purpose}|{boot}|", first, min(first + RUN_DRAWS - 1, n))
                times += np.bincount(keys % n, minlength=n)
        if now is not None:
            yield from rows()

    return spark.range(0, draws.n_boot * runs, numPartitions=tasks).mapInArrow(count, "block int, boot int, times binary")


def _resampled(keyed: DataFrame, n_keys: int, draws: Draws) -> DataFrame:
    """(_key, value): the mean of every key in every resample, NULL if none of its units is drawn. keyed(unit, v, _key) and
    the draws are cut at the same positions; a block's values (units x keys) are multiplied by its counts (resamples x units),
    and the products of the blocks are added up."""
    width = max(1, min(BLOCK_UNITS, BLOCK_BYTES // (16 * n_keys)))
    at = F.col("position") - 1
    # Both tables are rows of the same units: their estimates follow small files, so neither may be broadcast.
    values = keyed.join(draws.placed.hint("shuffle_hash"), "unit").select((at / width).cast("int").alias("block"), (at % width).cast("int").alias("at"), "_key", "v")

    def product(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"boot": [], "sums": []})
        cell, size = left["at"].to_numpy() * n_keys + left["_key"].to_numpy(), width * n_keys
        sums = [np.bincount(cell, weights, size).reshape(width, n_keys) for weights in (left["v"].to_numpy(), None)]
        table = np.concatenate(sums, axis=1).astype(float)
        out = []
        for low in range(0, len(right), 256):
            times = np.frombuffer(b"".join(right["times"].iloc[low:low + 256]), dtype="<u2").reshape(-1, width)
            out += [row.tobytes() for row in times.astype(float) @ table]
        return pd.DataFrame({"boot": right["boot"].to_numpy(), "sums": out})

    def means(some: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(2 * n_keys)
        for sums in some["sums"]:
            total += np.frombuffer(sums)
        drawn = total[n_keys:] > 0
        return pd.DataFrame({"_key": np.flatnonzero(drawn), "value": total[:n_keys][drawn] / total[n_keys:][drawn]})

    parts = values.groupBy("block").cogroup(_counted(draws, width).groupBy("block")).applyInPandas(product, "boot int, sums binary")
    return parts.groupBy("boot").applyInPandas(means, "_key int, value double")


def bootstrap_ci(values: DataFrame, draws: DataFrame | Draws, by: Sequence[str], unit_col: str = "query_id",
                 value: str = "value", decimals: int = 6) -> DataFrame:
    """(by..., n, mean, lo, hi): the mean and the 2.5 / 97.5 percentiles (linear interpolation) of the resampled
    means. NULL values are skipped in every resample.

    The combinations of `by` are the rows of a report, few enough to be read by the driver. Their values stand side by
    side in one row per unit, so the draws are joined once for COLUMNS of them and grouped by resample alone. Draws that
    are not made yet (`drawn_positions`) are counted in blocks and multiplied by the values of the same units."""
    by = list(by)
    defined = checkpoint(values.where(F.col(value).isNotNull()).select(*by, F.col(unit_col).alias("unit"), F.col(value).alias("v")))
    point = defined.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"))
    keys = checkpoint(point.select(*by).withColumn("_key", F.row_number().over(Window.orderBy(*by)) - 1))
    n_keys = keys.count()
    if n_keys > MAX_COMBINATIONS:
        raise ValueError(f"{n_keys} combinations of {by}: bootstrap a report of at most {MAX_COMBINATIONS}")
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"k.{c}")) for c in by]
    keyed = defined.alias("d").join(keys.alias("k"), reduce(and_, same)).select("unit", "v", "_key") if by else defined.select("unit", "v", F.lit(0).alias("_key"))
    parts = []
    if n_keys and isinstance(draws, Draws):
        parts.append(_resampled(keyed, n_keys, draws).groupBy("_key").agg(F.percentile("value", F.array(F.lit(0.025), F.lit(0.975))).alias("q")))
    # Neither side may be broadcast: estimates of `wide` and `draws` follow small files, their rows are many and wide.
    elif n_keys:
        draws = checkpoint(draws)
    for low in range(0, 0 if isinstance(draws, Draws) else n_keys, COLUMNS):
        some = range(low, min(low + COLUMNS, n_keys))
        wide = keyed.where(F.col("_key").between(some[0], some[-1])).groupBy("unit").agg(
            *[f(F.when(F.col("_key") == k, F.col("v"))).alias(f"{name}{k}") for k in some for name, f in (("s", F.sum), ("c", F.count))])
        sums = draws.join(wide.hint("shuffle_hash"), "unit").groupBy("boot").agg(*[(F.sum(F.col(f"s{k}") * F.col("times")) / F.nullif(F.sum(F.col(f"c{k}") * F.col("times")), F.lit(0))).alias(f"m{k}") for k in some])
        quantiles = sums.agg(*[F.percentile(f"m{k}", F.array(F.lit(0.025), F.lit(0.975))).alias(f"q{k}") for k in some])
        parts.append(quantiles.select(F.explode(F.array(*[F.struct(F.lit(k).alias("_key"), F.col(f"q{k}").alias("q")) for k in some])).alias("x")).select("x.*"))
    if not parts:
        return point.select(*by, "n", "mean", F.col("mean").alias("lo"), F.col("mean").alias("hi"))
    spread = keys.join(union_all(parts), "_key", "left")
    out = spread.alias("d").join(point.alias("k"), reduce(and_, same)).select(*[F.col(f"k.{c}").alias(c) for c in by], "n", "mean", "q") if by else spread.crossJoin(point)
    return out.select(*by, "n", F.round("mean", decimals).alias("mean"),
                      F.round(F.col("q")[0], decimals).alias("lo"), F.round(F.col("q")[1], decimals).alias("hi"))


def paired_diff_ci(values: DataFrame, draws: DataFrame, comparisons: DataFrame, system: str = "system",
                   by: Sequence[str] = ("metric",), unit_col: str = "query_id", decimals: int = 6) -> DataFrame:
    """CI of a - b over units for every named comparison(label, a, b); `significant` when 0 is outside."""
    by = list(by)
    left = values.select(F.col(system).alias("a"), *by, unit_col, F.col("value").alias("va"))
    right = values.select(F.col(system).alias("b"), *by, unit_col, F.col("value").alias("vb"))
    diffs = (comparisons.join(left, "a").join(right, ["b", *by, unit_col])
             .select("label", *by, unit_col, (F.col("va") - F.col("vb")).alias("value")))
    out = bootstrap_ci(diffs, draws, ["label", *by], unit_col, decimals=decimals)
    return out.withColumn("significant", (F.col("lo") > 0) | (F.col("hi") < 0))
