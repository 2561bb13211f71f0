"""The role-tag taxonomy: tracks(track_id, name), roles(role_id, name, track_id), tags(tag_id), and the bridge
(role_id, tag_id, level)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ranklab.operators.ordering import rank_list, upper_median
from ranklab.session import union_all


def taxonomy_assemble(roles: DataFrame, bridge: DataFrame, tracks: DataFrame, sectors: DataFrame | None = None,
                      truncated: DataFrame | None = None) -> DataFrame:
    """(role_id, track_id, track_name, sector, n_tags, tags): every role is kept, one without tags has the empty
    set. Sectors and restored names are optional."""
    sets = bridge.groupBy("role_id").agg(F.sort_array(F.collect_set("tag_id")).alias("tags"))
    named = display_name_restore(tracks, truncated) if truncated is not None else tracks.withColumn("display_name", F.col("name"))
    out = (roles.select("role_id", "track_id").join(named.select("track_id", F.col("display_name").alias("track_name")), "track_id", "left")
           .join(sets, "role_id", "left"))
    if sectors is not None:
        out = out.join(sectors.select("track_id", "sector"), "track_id", "left")
    else:
        out = out.withColumn("sector", F.lit(None).cast("string"))
    tags = F.coalesce("tags", F.array().cast("array<bigint>"))
    return out.select("role_id", "track_id", "track_name", "sector", F.size(tags).cast("bigint").alias("n_tags"), tags.alias("tags"))


def taxonomy_verify(roles: DataFrame, tags: DataFrame, tracks: DataFrame, bridge: DataFrame, levels: DataFrame,
                    expected: dict[str, int]) -> DataFrame:
    """(check, n_bad): row counts off the expectation, duplicate bridge pairs, dangling references, and the pair
    difference of levels and bridge in both directions. All checks are one union, so one job reports them all."""
    spark = roles.sparkSession
    tables = {"roles": roles, "tags": tags, "tracks": tracks, "bridge": bridge, "levels": levels}
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n_bad")).select(F.lit(name).alias("check"), "n_bad")
    parts = [tables[name].agg(F.abs(F.count(F.lit(1)) - F.lit(want)).alias("n_bad"))
             .select(F.lit(f"rows:{name}").alias("check"), "n_bad") for name, want in expected.items()]
    pairs = bridge.select("role_id", "tag_id").distinct()
    level_pairs = levels.select("role_id", "tag_id").distinct()
    parts += [
        bridge.groupBy("role_id", "tag_id").agg((F.count(F.lit(1)) - 1).alias("extra"))
        .agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("n_bad")).select(F.lit("duplicate_pairs").alias("check"), "n_bad"),
        count(pairs.select("role_id").distinct().join(roles, "role_id", "left_anti"), "unknown_roles"),
        count(pairs.select("tag_id").distinct().join(tags, "tag_id", "left_anti"), "unknown_tags"),
        count(roles.select("track_id").distinct().join(tracks, "track_id", "left_anti"), "unknown_tracks"),
        count(level_pairs.join(pairs, ["role_id", "tag_id"], "left_anti"), "only_in_levels"),
        count(pairs.join(level_pairs, ["role_id", "tag_id"], "left_anti"), "only_in_bridge"),
    ]
    return union_all(parts).select("check", F.col("n_bad").cast("bigint").alias("n_bad"))


def role_tag_sets(roles: DataFrame, bridge: DataFrame) -> DataFrame:
    """(role_id, tagset): the sorted tag set as one comparable key; roles without tags share the empty key."""
    sets = bridge.groupBy("role_id").agg(F.array_join(F.sort_array(F.collect_set("tag_id")), ",").alias("tagset"))
    return roles.select("role_id").join(sets, "role_id", "left").select("role_id", F.coalesce("tagset", F.lit("")).alias("tagset"))


def equivalence_classes(roles: DataFrame, bridge: DataFrame) -> DataFrame:
    """(role_id, class_id): the smallest role id with the identical tag set. The minimum per set is aggregated
    map-side and joined back, so a set shared by very many roles stays cheap."""
    sets = role_tag_sets(roles, bridge)
    reps = sets.groupBy("tagset").agg(F.min("role_id").alias("class_id"))
    return sets.join(reps, "tagset").select("role_id", "class_id")


def shared_tagset_count(roles: DataFrame, bridge: DataFrame) -> DataFrame:
    """One row: roles whose set is shared, number of classes, number of roles."""
    sizes = role_tag_sets(roles, bridge).groupBy("tagset").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_sharing"),
                     F.count(F.lit(1)).alias("n_classes"), F.sum("n").alias("n_roles"))


def duplicate_names(entities: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """(name, n_ids, id): every id of a name used by more than one id. One row per id instead of one array per
    name, so a name shared by a third of all entities is never gathered."""
    pairs = entities.select(F.col(id_col).alias("id"), F.col(name_col).alias("name")).distinct()
    counts = pairs.groupBy("name").agg(F.count(F.lit(1)).alias("n_ids")).where(F.col("n_ids") > 1)
    return pairs.join(counts, "name").select("name", "n_ids", "id")


def display_name_restore(tracks: DataFrame, truncated: DataFrame) -> DataFrame:
    """(track_id, name, display_name): the original of a name that was cut to fit its column."""
    restored = truncated.select(F.col("stored").alias("name"), "original")
    return tracks.join(restored, "name", "left").select("track_id", "name", F.coalesce("original", "name").alias("display_name"))


def track_distribution(ranked: DataFrame, role_track: DataFrame, top_r: int = 10, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(keys..., track_id, mass, track_rank): score mass of the top-R roles per track, normalised to 1; nothing
    for a query whose total is not positive."""
    keys = list(keys)
    top = ranked.where(F.col("rank") <= top_r).join(role_track.select(F.col("role_id").alias("doc_id"), "track_id"), "doc_id")
    mass = top.groupBy(*keys, "track_id").agg(F.sum("score").alias("m"))
    total = mass.groupBy(*keys).agg(F.sum("m").alias("total")).where(F.col("total") > 0)
    shares = mass.join(total, keys).select(*keys, "track_id", F.round(F.col("m") / F.col("total"), 9).alias("mass"))
    return rank_list(shares, keys=keys, score="mass", tie=("track_id",), out="track_rank")


def taxonomy_profile(roles: DataFrame, tags: DataFrame, bridge: DataFrame) -> DataFrame:
    """One row: min, upper median, max, mean tags per role; unused tags; roles."""
    pairs = bridge.select("role_id", "tag_id").distinct()
    sizes = roles.select("role_id").join(pairs.groupBy("role_id").agg(F.count(F.lit(1)).alias("n")), "role_id", "left").select(
        F.coalesce("n", F.lit(0)).alias("n"))
    unused = tags.select("tag_id").join(pairs.select("tag_id").distinct(), "tag_id", "left_anti").agg(F.count(F.lit(1)))
    stats = sizes.agg(F.count(F.lit(1)).alias("n_roles"), F.min("n").alias("min_tags"), F.max("n").alias("max_tags"),
                      F.round(F.avg("n"), 6).alias("mean_tags"))
    return stats.select("n_roles", "min_tags", upper_median(sizes, "n").scalar().alias("median_tags"), "max_tags",
                        "mean_tags", unused.scalar().alias("n_unused_tags"))


def most_generic_tags(bridge: DataFrame, k: int = 5) -> DataFrame:
    """(tag_id, n_roles) of the k most widespread tags."""
    df = bridge.select("role_id", "tag_id").distinct().groupBy("tag_id").agg(F.count(F.lit(1)).alias("n_roles"))
    return df.orderBy(F.col("n_roles").desc(), "tag_id").limit(k)


def level_histogram(levels: DataFrame) -> DataFrame:
    return levels.groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def track_union_docs(bridge: DataFrame, role_track: DataFrame) -> DataFrame:
    """(track_id, tag_id): a track's document is the union of its roles' tags."""
    return bridge.join(role_track.select("role_id", "track_id"), "role_id").select("track_id", "tag_id").distinct()
