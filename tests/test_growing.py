"""Growing and scoring trees: the fast ways give what the plain ones give."""

import numpy as np
import pytest

from ranklab.operators import ltr
from tests.test_plans import ranking_table


def bundle(n_queries=70, seed=2):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 9, n_queries)
    labels = rng.integers(0, 4, sizes.sum()) * np.repeat(rng.integers(0, 2, n_queries), sizes)
    codes = np.stack([rng.integers(0, c, len(labels)) for c in (9, 2, 5, 9)], axis=1).astype(np.uint8)
    return {"labels": labels.astype(np.int8), "codes": codes, "keys": rng.integers(-2 ** 62, 2 ** 62, len(labels)), "stops": np.cumsum(sizes), "folds": rng.integers(0, 3, n_queries)}


@pytest.mark.parametrize("linear", [False, True])
def test_rows_of_one_model_have_the_gradients_and_sums_of_the_common_passes(linear, monkeypatch):
    """Queries without pairs are left out, blocks are cut, columns are counted together: no sum changes."""
    monkeypatch.setattr(ltr, "PAIR_ROWS", 12)
    params, b = ltr.Params(bins=8), bundle()
    for fold, columns in ((1, (0, 1, 2, 3)), (ltr.FINAL, (3, 1))):
        model = ltr._Grown(0, 0, columns, fold, linear)
        rows = ltr._Rows(b, model, params)
        rows.groups = ltr._joint(rows.cells, 100)
        rows.joint = [ltr._joint_codes(rows.columns, rows.cells, g) for g in rows.groups]
        assert len(rows.groups) < len(columns) and len(rows.keys) < (b["folds"] != fold).repeat(np.diff(b["stops"], prepend=0)).sum()
        scores = dict(zip(b["keys"].tolist(), np.random.default_rng(5).normal(size=len(b["keys"])).round(1)))
        rows.score[:] = [scores[k] for k in rows.keys.tolist()]
        rows.gradients(3)
        g, h = ltr._gradients(b, [model], np.array([[scores[k] for k in b["keys"].tolist()]]), params, 3)
        codes = b["codes"][:, columns]
        splits = {1: (0, 4, True), 3: (1, 1, False)}
        node = np.ones(len(codes), dtype=np.int64)
        for depth, wanted in enumerate(([1], [2, 3], [2, 6, 7])):
            if depth:
                rows.down({n: s for n, s in splits.items() if n < 1 << depth})
                node = ltr.Flat.of({"splits": {n: s for n, s in splits.items() if n < 1 << depth}, "leaves": {}}, params.depth).walk(codes)
            for n, sums in zip(wanted, ltr._node_sums(codes, g[0], h[0], node, wanted, params)):
                assert rows.sums(n) == pytest.approx(sums)
                assert sums[0] == pytest.approx(np.stack([np.bincount(codes[node == n, j], g[0, node == n], 9) for j in range(len(columns))]))


def test_masks_lead_to_the_leaves_that_walking_leads_to():
    rng, cells = np.random.default_rng(0), [33, 3, 9, 33, 33]
    codes = np.stack([rng.integers(0, c, 900) for c in cells], axis=1).astype(np.uint8)

    def tree(node, level, depth):
        if level == depth or level and rng.random() < .2:
            return {"splits": {}, "leaves": {node: float(rng.normal())}}
        j = int(rng.integers(0, 5))
        split = {node: (j, int(rng.integers(1, cells[j])), bool(rng.random() < .5))}
        sides = [tree(2 * node + s, level + 1, depth) for s in (0, 1)]
        return {"splits": split | sides[0]["splits"] | sides[1]["splits"], "leaves": sides[0]["leaves"] | sides[1]["leaves"]}

    for depth in range(6):
        flats = [ltr.Flat.of(t, ltr._depth(t)) for t in (tree(1, 0, depth) for _ in range(8))]
        forest = ltr._Forest(flats, cells)
        assert (forest.masks is None) == (max(len(f.feature) for f in flats) > 32)
        assert (forest.score(codes) == sum(f.value[f.walk(codes)] for f in flats)).all()


def test_a_table_of_some_bundles_still_grows_in_one_job_and_as_in_common_passes(spark, monkeypatch):
    """Before, passes over a table beyond one bundle were jobs of their own, one for each level of each tree."""
    table, jobs, models = ranking_table(spark), [], []
    folds, specs = ltr.group_kfold(table, 3), {"m": ltr.Spec("a", ("good", "rrf")), "lin": ltr.Spec("a", ("rrf",), True)}
    monkeypatch.setattr(ltr, "BUNDLE_ROWS", 10)
    for trees, bundles in ((2, 20), (6, 20), (6, 0)):
        monkeypatch.setattr(ltr, "ALONE_BUNDLES", bundles)
        group = f"some-{trees}-{bundles}"
        spark.sparkContext.setJobGroup(group, group)
        models.append(ltr.fit_all({"a": table}, specs, folds, ltr.Params(trees=trees, depth=3, rate=.5, min_child_weight=.01), 3)[0])
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
    spark.sparkContext.setJobGroup("", "")
    assert jobs[0] == jobs[1] < jobs[2]
    for name in specs:
        for fold, trees in models[1][name].trees.items():
            assert [t["splits"] for t in trees] == [t["splits"] for t in models[2][name].trees[fold]]
            assert all(t["leaves"] == pytest.approx(o["leaves"]) for t, o in zip(trees, models[2][name].trees[fold]))


def test_channels_and_grades_are_made_once_for_both_candidate_tables(spark, monkeypatch):
    from ranklab.catalog import pairs, ranking, tables
    from ranklab.catalog.lists import rrf3
    from ranklab.operators.features import tag_features
    from tests.test_plans import SMALL
    made = []
    monkeypatch.setattr(ranking, "MADE", {})
    for name in ("ev_lists", "ev_grades"):
        monkeypatch.setattr(tables, name, lambda *a, real=getattr(tables, name), name=name: made.append(name) or real(*a))
    raw, tag = (ranking.candidate_table(spark, SMALL, n) for n in ("raw", "tag_raw"))
    assert sorted(made) == ["ev_grades", "ev_lists"]
    plain = pairs.candidates_of(rrf3(spark, SMALL, top=50), tables.ev_list(spark, SMALL, "click"), tables.ev_list(spark, SMALL, "view"),
                                tables.gig_struct(spark, SMALL), tables.provider_struct(spark, SMALL), tables.ev_grades(spark, SMALL))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(raw.collect(), key=key) == sorted(pairs.candidates(spark, SMALL).collect(), key=key)
    assert sorted(tag.collect(), key=key) == sorted(tag_features(plain, tables.ev_list(spark, SMALL, "purchase"), raw=False).collect(), key=key)
    assert {r.query_id for r in tables.ev_score_queries(spark, SMALL).collect()} == {r.query_id for r in tables.ev_scores(spark, SMALL).select("query_id").collect()}


def test_intervals_of_counted_draws_are_those_of_draw_rows(spark, monkeypatch):
    """Values with gaps and repeats, blocks of few units and resamples cut between tasks."""
    from pyspark.sql import functions as F
    from ranklab.operators import bootstrap as bs
    rng = np.random.default_rng(4)
    rows = [(u, k, None if rng.random() < .3 else float(rng.normal())) for u in range(40) for k in ("a", "b", "c") for _ in range(1 + (u == 7))]
    values, units = spark.createDataFrame(rows, "unit bigint, key string, value double"), spark.range(60).withColumnRenamed("id", "unit")
    want = bs.bootstrap_ci(values, bs.boot_draws(units, "unit", 90, purpose="p"), ["key"], "unit").collect()
    for name, value in (("BLOCK_UNITS", 7), ("RUN_DRAWS", 11), ("TASK_DRAWS", 500)):
        monkeypatch.setattr(bs, name, value)
    got = bs.bootstrap_ci(values, bs.drawn_positions(units, "unit", 90, purpose="p"), ["key"], "unit")
    assert sorted(got.collect()) == sorted(want) and len(want) == 3
    one = spark.range(1).select(F.col("id").alias("unit"), F.lit("a").alias("key"), F.lit(2.0).alias("value"))
    many = bs.Draws(spark.createDataFrame([(0, 1)], "unit bigint, position bigint"), 1, 3, 7, "p")
    assert [tuple(r) for r in bs.bootstrap_ci(one, many, ["key"], "unit").collect()] == [("a", 1, 2.0, 2.0, 2.0)]


def test_differences_of_the_ablation_make_metrics_once_and_no_row_for_a_draw(spark, monkeypatch):
    from ranklab.operators import bootstrap as bs
    from ranklab.operators.metrics import to_long
    from ranklab.plans import ranking as plan
    rng = np.random.default_rng(9)
    rows = [(lab, "standard", f"{side}_{stage}", q, *[None if rng.random() < .2 else float(rng.random()) for _ in range(2)])
            for lab in ("x", "y") for side in ("tag", "base") for stage in ("rrf", "fused") for q in range(12) if (side, q) != ("tag", 3)]
    per = spark.createDataFrame(rows, "labels string, treatment string, system string, query_id bigint, p_5 double, mrr double")
    queries = per.select("query_id").distinct()
    got = plan.ablation_differences(per, queries, 50)
    long = [r for r in to_long(per, plan.ABLATION).collect() if r.value is not None]
    at = {(r.labels, r.treatment, r.system, r.query_id, r.metric): r.value for r in long}
    diff = [(a, b, s[4:], q, m, v - at[a, b, "base_" + s[4:], q, m]) for (a, b, s, q, m), v in at.items() if s.startswith("tag_") and (a, b, "base_" + s[4:], q, m) in at]
    frame = spark.createDataFrame(diff, "labels string, treatment string, stage string, query_id bigint, metric string, value double")
    want = bs.bootstrap_ci(frame, bs.boot_draws(queries, "query_id", 50, purpose="downstream/boot"), ["labels", "treatment", "stage", "metric"])
    assert sorted(r[:8] for r in got.collect()) == sorted(tuple(r) for r in want.collect()) and len(diff) > 40
    monkeypatch.setattr(bs, "boot_draws", lambda *a, **k: pytest.fail("a row for each draw"))
    plan.ablation_differences(per, queries, 50)


def test_numbered_keys_are_those_of_md5(spark, monkeypatch):
    from hashlib import md5
    from pyspark.sql import functions as F
    from ranklab.functions import keys
    monkeypatch.setattr(keys, "HASHED_AT_ONCE", 50)
    for prefix in ("", "7|p|1|", "7|downstream/boot|2000|", "é|", "x" * 52, "x" * 53, "x" * 54, "x" * 70):
        for first, last in ((0, 130), (95, 1003), (10 ** 9 - 3, 10 ** 9 + 3), (5, 4)):
            assert keys.numbered_keys(prefix, first, last).tolist() == [int(md5(f"{prefix}{x}".encode()).hexdigest()[:15], 16) for x in range(first, last + 1)]
    made = spark.range(1, 30).select(keys.key_to_long(keys.seeded_key(7, "boot", F.lit(3), "id"))).collect()
    assert [r[0] for r in made] == keys.numbered_keys("7|boot|3|", 1, 29).tolist()
