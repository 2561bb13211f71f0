"""Judging pools, seeded samples and splits.

Every random choice orders rows by an md5 of (seed, purpose, ids): reproducible, independent of partitioning,
and a top-n by that key is a uniform sample without replacement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ranklab.functions.keys import key_to_long, seeded_key
from ranklab.operators.ordering import global_rank
from ranklab.session import checkpoint, union_all

PAIR = ["query_id", "doc_id"]


def judging_pool(lists: Sequence[tuple[str, DataFrame, int]]) -> DataFrame:
    """pool(query_id, doc_id, sources): union of every list's top-n; sources in the given order."""
    parts = [df.where(F.col("rank") <= n).select(*PAIR, F.struct(F.lit(i).alias("no"), F.lit(name).alias("source")).alias("s"))
             for i, (name, df, n) in enumerate(lists)]
    return union_all(parts).groupBy(*PAIR).agg(
        F.transform(F.array_sort(F.collect_set("s")), lambda s: s["source"]).alias("sources"))


def random_outside_pool(queries: DataFrame, docs: DataFrame, pool: DataFrame, r: int, seed: int = 7) -> DataFrame:
    """r documents per query that are not pooled, uniform and seeded.

    Documents get one global random order; a query reads it from its own seeded offset and takes the first r
    documents outside its pool. Only r + pool-size positions per query are looked at, never queries x documents."""
    order = global_rank(docs.select("doc_id").distinct().withColumn("key", seeded_key(seed, "outside/docs", "doc_id")), "key", "position")
    n_docs = docs.select("doc_id").distinct().agg(F.count(F.lit(1))).scalar()
    sizes = pool.select(*PAIR).distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("pooled"))
    start = key_to_long(seeded_key(seed, "outside/start", "query_id"))
    spans = (queries.select("query_id").distinct().join(sizes, "query_id", "left").withColumn("n_docs", n_docs)
             .withColumn("span", F.least(F.coalesce("pooled", F.lit(0)) + F.lit(r), F.col("n_docs")))
             .withColumn("step", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("span") - 1)))
             .select("query_id", "step", (F.pmod(start + F.col("step"), F.col("n_docs")) + 1).alias("position")))
    outside = spans.join(order.select("doc_id", "position"), "position").join(pool.select(*PAIR).distinct(), PAIR, "left_anti")
    w = Window.partitionBy("query_id").orderBy("step")
    return outside.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= r).select(*PAIR)


def pool_additions(ranked: DataFrame, pool: DataFrame, n: int) -> DataFrame:
    """The channel's top-n not already pooled; the pool itself is untouched."""
    return ranked.where(F.col("rank") <= n).select(*PAIR).join(pool.select(*PAIR), PAIR, "left_anti")


def pool_cover_k(lists: Sequence[DataFrame], pool: DataFrame, k: int) -> DataFrame:
    """Every pair in some channel's top-k that is not pooled yet."""
    tops = union_all([df.where(F.col("rank") <= k).select(*PAIR) for df in lists])
    return tops.distinct().join(pool.select(*PAIR), PAIR, "left_anti")


def pool_stats(pool: DataFrame) -> DataFrame:
    sizes = pool.select(*PAIR).distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.min("n").alias("min_size"), F.round(F.avg("n"), 6).alias("mean_size"), F.max("n").alias("max_size"),
                     F.sum("n").alias("total_pairs"))


def compared_pool(lists: Sequence[DataFrame], queries: DataFrame, top: int = 10) -> DataFrame:
    """Distinct pairs over all compared top lists of the chosen queries."""
    tops = union_all([df.where(F.col("rank") <= top).select(*PAIR) for df in lists])
    return tops.join(queries.select("query_id").distinct(), "query_id", "left_semi").distinct()


def halves(units: DataFrame, unit_col: str, seed: int, purpose: str, first: str = "dev", second: str = "test") -> DataFrame:
    """(unit, split): a seeded permutation cut in half; the first half has floor(n / 2) units."""
    keyed = units.select(unit_col).distinct().withColumn("key", seeded_key(seed, purpose, unit_col))
    placed = global_rank(keyed, "key", "position").withColumn("n", keyed.agg(F.count(F.lit(1))).scalar())
    return placed.select(unit_col, F.when(F.col("position") <= F.floor(F.col("n") / 2), first).otherwise(second).alias("split"))


def dev_test_split(queries: DataFrame, gains: DataFrame, seed: int = 7, threshold: float = 40) -> DataFrame:
    """Queries with a relevant document, in seeded halves."""
    positive = gains.where(F.col("gain") >= threshold).select("query_id").distinct()
    return halves(queries.select("query_id").distinct().join(positive, "query_id", "left_semi"), "query_id", seed, "sat/split")


def class_split(classes: DataFrame, seed: int = 7) -> DataFrame:
    """(role_id, class_id, split): whole equivalence classes, so twins never straddle the split."""
    return classes.join(halves(classes, "class_id", seed, "split"), "class_id").select("role_id", "class_id", "split")


# Query conditions - name, query size, tag choice, wrong tags, draws per class, source of wrong tags.
CONDITIONS = (
    ("default_5", 5, "random", 0, 5, "vocab"),
    ("few_3", 3, "random", 0, 5, "vocab"),
    ("clean_4", 4, "random", 0, 5, "vocab"),
    ("many_10", 10, "random", 0, 5, "vocab"),
    ("generic_5", 5, "generic", 0, 1, "vocab"),
    ("specific_5", 5, "specific", 0, 1, "vocab"),
    ("wrong1_on_4", 5, "random", 1, 5, "vocab"),
    ("wrong1_on_5", 6, "random", 1, 5, "vocab"),
    ("wrong2_on_3", 5, "random", 2, 5, "vocab"),
    ("near1_on_5", 6, "random", 1, 5, "track"),
    ("near2_on_3", 5, "random", 2, 5, "track"),
)


def _condition_array(conditions: Sequence[tuple]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("condition"), F.lit(size).alias("size"), F.lit(mode).alias("mode"),
                              F.lit(wrong).alias("n_wrong"), F.lit(draws).alias("draws"), F.lit(source).alias("source"))
                     for n, size, mode, wrong, draws, source in conditions])


def query_sampler(classes: DataFrame, class_tags: DataFrame, track_tags: DataFrame, vocab: DataFrame,
                  conditions: Sequence[tuple] = CONDITIONS, seed: int = 7) -> DataFrame:
    """(condition, class_id, draw, tag_id, wrong): the tags of every sampled query.

    classes(class_id, track_id), class_tags(class_id, tag_id), track_tags(track_id, tag_id), vocab(tag_id). Right
    tags: the first `size - wrong` of the class's tags by hash, or by document frequency. Wrong tags come from
    sibling roles of the track when there are enough, else from the vocabulary; the vocabulary is read from one
    seeded order at the query's own offset, so no class meets the whole vocabulary."""
    draws = (classes.select("class_id", "track_id").withColumn("c", F.explode(_condition_array(conditions)))
             .select("class_id", "track_id", "c.*")
             .withColumn("draw", F.explode(F.sequence(F.lit(1), F.col("draws")))))
    df = class_tags.groupBy("tag_id").agg(F.count(F.lit(1)).alias("df"))
    tagged = class_tags.join(df, "tag_id")
    key = seeded_key(seed, "queries", "condition", "class_id", "draw", "tag_id")
    level = F.when(F.col("mode") == "specific", F.col("df")).when(F.col("mode") == "generic", -F.col("df")).otherwise(F.lit(0))
    second = F.when(F.col("mode") == "specific", F.col("tag_id")).when(F.col("mode") == "generic", -F.col("tag_id")).otherwise(F.lit(0))
    by_query = ["condition", "class_id", "draw"]
    w = Window.partitionBy(*by_query).orderBy("l1", "l2", "key")
    right = (draws.join(tagged, "class_id").withColumn("l1", level).withColumn("l2", second).withColumn("key", key)
             .withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= F.col("size") - F.col("n_wrong"))
             .select(*by_query, "tag_id", F.lit(0).alias("wrong")))
    noisy = draws.where(F.col("n_wrong") > 0)
    sizes = class_tags.groupBy("class_id").agg(F.count(F.lit(1)).alias("own"))
    siblings = (classes.select("class_id", "track_id").join(track_tags, "track_id")
                .join(class_tags, ["class_id", "tag_id"], "left_anti").select("class_id", "tag_id"))
    n_siblings = siblings.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_sib"))
    noisy = noisy.join(n_siblings, "class_id", "left").join(sizes, "class_id", "left").withColumn(
        "near", (F.col("source") == "track") & (F.coalesce("n_sib", F.lit(0)) >= F.col("n_wrong")))
    wkey = seeded_key(seed, "wrong", "condition", "class_id", "draw", "tag_id")
    near = (noisy.where("near").join(siblings, "class_id").withColumn("key", wkey)
            .withColumn("pos", F.row_number().over(Window.partitionBy(*by_query).orderBy("key")))
            .where(F.col("pos") <= F.col("n_wrong")))
    order = global_rank(vocab.select("tag_id").distinct().withColumn("key", seeded_key(seed, "vocab", "tag_id")), "key", "position")
    n_vocab = vocab.select("tag_id").distinct().agg(F.count(F.lit(1))).scalar()
    start = key_to_long(seeded_key(seed, "wrong/start", "condition", "class_id", "draw"))
    far = (noisy.where(~F.col("near")).withColumn("n_vocab", n_vocab)
           .withColumn("span", F.least(F.coalesce("own", F.lit(0)) + F.col("n_wrong"), F.col("n_vocab")))
           .withColumn("step", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("span") - 1)))
           .withColumn("position", F.pmod(start + F.col("step"), F.col("n_vocab")) + 1)
           .join(order.select("tag_id", "position"), "position")
           .join(class_tags, ["class_id", "tag_id"], "left_anti")
           .withColumn("pos", F.row_number().over(Window.partitionBy(*by_query).orderBy("step")))
           .where(F.col("pos") <= F.col("n_wrong")))
    wrong = union_all([near.select(*by_query, "tag_id"), far.select(*by_query, "tag_id")]).withColumn("wrong", F.lit(1))
    return union_all([right, wrong])


def permuted_control(query_tags: DataFrame, seed: int = 7) -> DataFrame:
    """Each query gets the tags of another one: query number i by id takes those of number i by hash."""
    ids = query_tags.select("query_id").distinct()
    by_id = global_rank(ids, "query_id", "position")
    by_hash = global_rank(ids.withColumn("key", seeded_key(seed, "permute", "query_id")), "key", "position")
    mapping = by_id.join(by_hash.select("position", F.col("query_id").alias("donor")), "position")
    return mapping.join(query_tags.select(F.col("query_id").alias("donor"), "tag_id"), "donor").select("query_id", "tag_id")


def sample_per_group(df: DataFrame, group: Sequence[str], key: Column, n) -> DataFrame:
    """At most n rows per group, the smallest keys first (a WindowGroupLimit cuts before the shuffle)."""
    keyed = df.withColumn("_key", key)
    w = Window.partitionBy(*group).orderBy("_key")
    return keyed.withColumn("_pos", F.row_number().over(w)).where(F.col("_pos") <= n).drop("_key", "_pos")


def stratified_calibration_sample(labels: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """At most n graded pairs per grade."""
    return sample_per_group(labels.select(*PAIR, "grade"), ["grade"], seeded_key(seed, "calibration", *PAIR), n)


def stratified_audit_sample(records: DataFrame, strata: Sequence[tuple[str, Column, int]], used: DataFrame | None = None,
                            seed: int = 7, prefix: str = "A", strict: bool = True) -> DataFrame:
    """(item, query_id, doc_id, stratum, grade): per-stratum quotas, no pair of an earlier round, at most one pair
    per query over all strata.

    Strata are filled one after another, each in seeded order of its pairs: a pair whose query has been taken is passed
    over, so a query that a full stratum has refused may still serve a later one. Within a stratum that serial draw is
    every free query's first pair, and of these the first `quota`; only the strata are a loop. A quota bounds what a
    stratum's draw brings together. A short stratum is an error when `strict`."""
    rows = records if used is None else records.join(used.select(*PAIR), PAIR, "left_anti")
    keyed = checkpoint(rows.select(*PAIR, "grade", F.array(*[F.coalesce(keep, F.lit(False)) for _, keep, _ in strata]).alias("fits"))
                       .where(F.exists("fits", lambda x: x)).withColumn("key", seeded_key(seed, "audit", *PAIR)))
    taken: list[DataFrame] = []
    short = []
    for i, (name, _, quota) in enumerate(strata):
        free = keyed.where(F.col("fits")[i])
        if taken:
            free = free.join(union_all(taken).select("query_id"), "query_id", "left_anti")
        first = free.groupBy("query_id").agg(F.min_by(F.struct("doc_id", "grade", "key"), "key").alias("r")).select("query_id", "r.*")
        picked = checkpoint(first.orderBy("key").limit(quota).select(*PAIR, "grade", F.lit(name).alias("stratum")))
        n = picked.count()
        if n < quota:
            short.append(f"{name}: {n} of {quota}")
        taken.append(picked)
    if strict and short:
        raise ValueError("short strata - " + "; ".join(short))
    placed = global_rank(union_all(taken).withColumn("shuffle", seeded_key(seed, "audit/items", *PAIR)), "shuffle", "item_no")
    return placed.select(F.format_string(f"{prefix}%03d", F.col("item_no")).alias("item"), *PAIR, "stratum", "grade")


def matched_pair_sample(diff: DataFrame, graded: DataFrame, n: int, used: DataFrame | None = None, seed: int = 10) -> DataFrame:
    """(query_id, doc_id, side, grade): for each of n sampled queries one entering and one leaving graded pair."""
    rows = diff.join(graded.select(*PAIR, "grade"), PAIR)
    if used is not None:
        rows = rows.join(used.select(*PAIR), PAIR, "left_anti")
    keyed = rows.withColumn("key", seeded_key(seed, "matched", *PAIR))
    one = keyed.groupBy("query_id", "side").agg(F.min_by(F.struct("doc_id", "grade"), "key").alias("r")).select("query_id", "side", "r.*")
    both = one.groupBy("query_id").agg(F.count(F.lit(1)).alias("sides")).where(F.col("sides") == 2).select("query_id")
    chosen = both.withColumn("key", seeded_key(seed, "matched/query", "query_id")).orderBy("key").limit(n).select("query_id")
    return one.join(chosen, "query_id").select(*PAIR, "side", "grade")


def hard_negative_triplets(queries: DataFrame, docs: DataFrame, gains: DataFrame, seed: int = 7, limit_score: float = 70) -> DataFrame:
    """(query_id, positive_id, negative_id): the best-scored positive and a seeded negative of the same category
    that is another document and scores below the limit; without one, a document of another category.

    The negative is found by walking the category's seeded order from the query's own offset past the few
    documents its labels exclude, so a category holding a third of all documents is never paired with its
    queries."""
    best = gains.groupBy("query_id").agg(F.max_by("doc_id", F.struct(F.col("gain"), -F.col("doc_id"))).alias("positive_id"))
    anchors = queries.select("query_id", "category").join(best, "query_id")
    excluded = union_all([gains.where(F.col("gain") >= limit_score).select(*PAIR),
                          best.select("query_id", F.col("positive_id").alias("doc_id"))]).distinct()
    barred = excluded.join(docs.select("doc_id", "category"), "doc_id").join(
        queries.select("query_id", "category"), ["query_id", "category"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("barred"))
    keyed = docs.select("doc_id", "category").withColumn("key", seeded_key(seed, "negatives", "doc_id"))
    from ranklab.operators.ordering import prefix_sum
    order = prefix_sum(keyed, ["category"], [F.col("key")], F.lit(1), "position")
    sizes = docs.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    start = key_to_long(seeded_key(seed, "negatives/start", "query_id"))
    walk = (anchors.join(barred, "query_id", "left").join(sizes, "category", "left")
            .withColumn("span", F.least(F.coalesce("barred", F.lit(0)) + 1, F.coalesce("n", F.lit(0)))).where(F.col("span") > 0)
            .withColumn("step", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("span") - 1)))
            .withColumn("position", F.pmod(start + F.col("step"), F.col("n")) + 1)
            .join(order.select("category", "position", "doc_id"), ["category", "position"])
            .join(excluded, PAIR, "left_anti"))
    same = walk.groupBy("query_id").agg(F.min_by("doc_id", "step").alias("negative_id"))
    missing = anchors.join(same, "query_id", "left_anti")
    fallback = _other_category(missing, keyed, sizes, start)
    found = union_all([same, fallback])
    return anchors.join(found, "query_id").select("query_id", "positive_id", "negative_id")


def _other_category(anchors: DataFrame, keyed: DataFrame, sizes: DataFrame, start: Column) -> DataFrame:
    """A seeded document outside the anchor's category: categories laid end to end, the anchor's own skipped."""
    order = global_rank(keyed.withColumn("ckey", F.md5(F.col("category"))).withColumn(
        "okey", F.concat(F.col("ckey"), F.col("key"))), "okey", "position")
    spans = order.groupBy("category").agg(F.min("position").alias("first"), F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n")).scalar()
    rows = anchors.join(spans, "category", "left").withColumn("total", total)
    size, first = F.coalesce("n", F.lit(0)), F.coalesce("first", F.lit(1))
    left = F.col("total") - size
    raw = F.pmod(start, F.nullif(left, F.lit(0))) + 1
    placed = rows.withColumn("position", F.when(raw >= first, raw + size).otherwise(raw))
    return placed.join(order.select("position", F.col("doc_id").alias("negative_id")), "position").select("query_id", "negative_id")


def train_eval_split(rows: DataFrame, id_col: str, seed: int = 7, share: float = 0.15) -> DataFrame:
    """(id, split): a seeded shuffle; the first share (at least one row) is held out."""
    keyed = rows.select(id_col).withColumn("key", seeded_key(seed, "train/eval", id_col))
    placed = global_rank(keyed, "key", "position").withColumn("n", keyed.agg(F.count(F.lit(1))).scalar())
    held = F.greatest(F.floor(F.col("n") * F.lit(share)), F.lit(1))
    return placed.select(id_col, F.when(F.col("position") <= held, "eval").otherwise("train").alias("split"))
