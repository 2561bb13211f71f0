"""Hand-checked inputs with known answers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ranklab.functions import fits
from ranklab.functions.text import match_text, stem
from ranklab.operators import agreement as ag
from ranklab.operators import features as fe
from ranklab.operators import fusion as fu
from ranklab.operators import hubness as hb
from ranklab.operators import labels as lb
from ranklab.operators import metrics as me
from ranklab.operators import roles as ro
from ranklab.operators import tags as tg
from ranklab.operators import taxonomy as tx


def ranked(spark, lists):
    rows = [(q, d, i) for q, ids in lists.items() for i, d in enumerate(ids, 1)]
    return spark.createDataFrame(rows, "query_id bigint, doc_id bigint, rank int")


def as_map(df, key="doc_id", value="score"):
    return {r[key]: r[value] for r in df.collect()}


@pytest.fixture(scope="module")
def tag_world(spark):
    docs = {10: (101, 102), 20: (101, 102, 103, 104), 30: (103, 104), 40: (105,)}
    pairs = spark.createDataFrame([(d, t, 2) for d, ts in docs.items() for t in ts], "doc_id bigint, tag_id bigint, level int")
    return pairs, spark.createDataFrame([(d,) for d in docs], "doc_id bigint")


def query_tags(spark, *tags):
    return spark.createDataFrame([(1, t) for t in tags], "query_id bigint, tag_id bigint")


def test_tag_bm25(spark, tag_world):
    pairs, docs = tag_world
    ln2 = math.log(2)
    out = tg.tag_rank(pairs, docs, query_tags(spark, 101, 102, 103)).orderBy("rank").collect()
    assert [r.doc_id for r in out] == [20, 10, 30]
    want = {10: 2 * ln2 * 2.2 / 2.1, 20: 3 * ln2 * 2.2 / 2.9, 30: ln2 * 2.2 / 2.1}
    assert all(abs(r.score - want[r.doc_id]) < 1e-8 for r in out)
    score = lambda q, m, **kw: as_map(tg.tag_scores(pairs, docs, q, m, **kw))
    q3 = query_tags(spark, 101, 102, 103)
    assert score(q3, "coverage") == pytest.approx({10: 2 / 3, 20: 1.0, 30: 1 / 3})
    assert score(q3, "idf_overlap") == pytest.approx(score(q3, "bm25", b=0.0))
    assert score(q3, "sum_levels") == {10: 4.0, 20: 6.0, 30: 2.0}
    assert score(query_tags(spark, 101, 999), "bm25") == score(query_tags(spark, 101), "bm25")
    assert score(query_tags(spark, 101, 101, 102), "bm25") == score(query_tags(spark, 101, 102), "bm25")
    kept = as_map(tg.tag_from_pairs(pairs, spark.createDataFrame([(40,), (10,), (99,)], "doc_id bigint")), value="n_tags")
    assert kept == {40: 1, 10: 2, 99: 0}
    with pytest.raises(ValueError):
        tg.tag_scores(pairs, docs, q3, b=1.5)


def test_weighted_cosine(spark):
    w = {10: {101: 3.0, 102: 2.0}, 20: {101: 2.0, 103: 4.0}, 30: {104: 0.5, 105: 3.0}}
    docs = spark.createDataFrame([(d, t, x) for d, m in w.items() for t, x in m.items()], "doc_id bigint, tag_id bigint, weight double")
    score = lambda m: as_map(tg.tag_weighted_cosine(docs, spark.createDataFrame([(1, t, x) for t, x in m.items()], "query_id bigint, tag_id bigint, weight double")))
    assert score({101: 3.0, 102: 2.0}) == pytest.approx({10: 1.0, 20: 2 / math.sqrt(50)}, abs=1e-8)
    assert score({104: 0.5}) == {}
    assert list(score({105: 3.0})) == [30]


def test_rrf(spark):
    a, b, c = ranked(spark, {1: [1, 2, 3]}), ranked(spark, {1: [2, 3, 4]}), ranked(spark, {1: [3, 5]})
    out = fu.rrf_fuse_n([a, b, c]).orderBy("rank").collect()
    assert [r.doc_id for r in out] == [3, 2, 1, 5, 4]
    assert out[0].score == pytest.approx(1 / 63 + 1 / 62 + 1 / 61)
    order = lambda *lists: [r.doc_id for r in fu.rrf_fuse_n([ranked(spark, {1: x}) for x in lists]).orderBy("rank").collect()]
    assert order([1, 2], [2, 1]) == [1, 2] and order([2, 1], [1, 2]) == [2, 1]
    zero = as_map(fu.rrf_fuse_n([a, c], [1.0, 0.0]))
    assert zero[5] == 0.0
    with pytest.raises(ValueError):
        fu.rrf_fuse_n([a, b], [1.0])
    only_first = fu.fuse_systems([a, ranked(spark, {1: [9], 2: [1]})], [1, 1])
    assert {r.query_id for r in only_first.collect()} == {1}
    table = lambda s: spark.createDataFrame([(1, i, x) for i, x in enumerate(s)], "query_id bigint, doc_id bigint, score double")
    tied = as_map(fu.rrf_tied_rank([table([.9, .9, .5, 0.0]), table([.1, .1, .8, .3])], [True, False]))
    assert tied == pytest.approx({0: 1 / 61 + 1 / 63, 1: 1 / 61 + 1 / 63, 2: 1 / 63 + 1 / 61, 3: 1 / 62})
    assert fu.pool_depth(50) >= 160


def test_two_lists_equal_n_lists(spark):
    import random
    rng = random.Random(3)
    pick = lambda: {q: rng.sample(range(20), 8) for q in range(30)}
    a, b = ranked(spark, pick()), ranked(spark, pick())
    key = lambda df: {(r.query_id, r.doc_id): r.score for r in df.collect()}
    assert key(fu.rrf_fuse2(a, b)) == key(fu.rrf_fuse_n([a, b]))


def test_metrics(spark):
    lists = ranked(spark, {1: [9, 5, 6], 2: [1, 2, 3]})
    gains = spark.createDataFrame([(1, 5, 100.0), (1, 6, 33.0)], "query_id bigint, doc_id bigint, gain double")
    got = {r.query_id: r for r in me.metrics_per_query(lists, gains, (5,)).collect()}
    assert got[1].p_5 == pytest.approx(1 / 3) and got[1].r_5 == 1.0 and got[1].mrr == 0.5
    assert got[1].ndcg_5 == pytest.approx((100 / math.log2(3) + 33 / 2) / (100 + 33 / math.log2(3)))
    assert got[2].p_5 == 0 and got[2].r_5 is None and got[2].ndcg_5 == 0 and got[2].mrr == 0
    judged = spark.createDataFrame([(1, 5), (1, 6)], "query_id bigint, doc_id bigint")
    condensed = me.metrics_per_query(me.condensed_lists(lists, judged), gains, (5,)).collect()
    assert condensed[0].mrr == 1.0
    lists2 = ranked(spark, {1: [1, 2, 3, 4], 2: [1, 2]})
    judged2 = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2)], "query_id bigint, doc_id bigint")
    assert me.judged_share(lists2, judged2, (4,), lists2).first()[0] == 0.75
    channels = [("t", ranked(spark, {1: [1, 2, 3, 4]})), ("x", ranked(spark, {1: [2, 8, 9]})), ("y", ranked(spark, {1: [3, 5, 6]}))]
    from ranklab.session import union_all
    stacked = union_all([df.withColumn("channel", F.lit(n)) for n, df in channels])
    positives = spark.createDataFrame([(1, 1), (1, 3), (1, 7)], "query_id bigint, doc_id bigint")
    found = me.unique_positives(stacked, positives, (3,)).where("channel = 't'").collect()
    assert [r.doc_id for r in found] == [1]


def test_auc_and_spearman(spark):
    auc = lambda s, y: me.auc(spark.createDataFrame(list(zip(s, y)), "s double, y int"), "s", "y").first().auc
    assert auc([.9, .8, .1, .2], [1, 1, 0, 0]) == 1 and auc([.5, .5], [1, 0]) == .5 and auc([.5], [1]) is None
    rho = lambda a, b: me.spearman_by(spark.createDataFrame(list(zip(a, b)), "a double, b double"), "a", "b").first().spearman
    assert rho([1., 2., 3.], [3., 2., 1.]) == pytest.approx(-1) and rho([1., 1., 2.], [5., 5., 9.]) == pytest.approx(1) and rho([1., 1.], [2., 3.]) == 0


def test_tie_aware_hits(spark):
    classes = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4), (5, 5)], "role_id bigint, class_id bigint")
    truth = spark.createDataFrame([(1, 1)], "query_id bigint, class_id bigint")
    n = classes.select("class_id").distinct().agg(F.count(F.lit(1)))

    def hits(scores, drop=True):
        df = spark.createDataFrame([(1, i + 1, s) for i, s in enumerate(scores) if s is not None], "query_id bigint, doc_id bigint, score double")
        return ro.tie_aware_hits(ro.class_scores(df, classes), truth, n, drop_nonpositive=drop).first()

    assert hits([.9, .9, .9, .5, .1]).role_1 == .5 and hits([.9, .9, .9, .5, .1]).role_5 == 1
    assert hits([.5] * 5).role_1 == .25
    assert hits([None, None, .9, .5, .1]).role_10 == 0


def test_taxonomy(spark):
    tags = {1: (1, 2), 2: (1, 2), 3: (2, 3), 4: (3,), 5: (1,)}
    bridge = spark.createDataFrame([(r, t) for r, ts in tags.items() for t in ts], "role_id bigint, tag_id bigint")
    roles = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 3), (5, 3)], "role_id bigint, track_id bigint")
    tracks = spark.createDataFrame([(1, "Alpha"), (2, "Beta"), (3, "Alpha")], "track_id bigint, name string")
    vocab = spark.createDataFrame([(1,), (2,), (3,)], "tag_id bigint")
    assert as_map(tx.equivalence_classes(roles, bridge), "role_id", "class_id") == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    assert tx.shared_tagset_count(roles, bridge).first().n_sharing == 2
    assert sorted(r.id for r in tx.duplicate_names(tracks, "track_id", "name").collect()) == [1, 3]
    best = spark.createDataFrame([(1, 1, 3.0, 1), (1, 3, 1.0, 2), (1, 4, 1.0, 3)], "query_id bigint, doc_id bigint, score double, rank int")
    assert as_map(tx.track_distribution(best, roles), "track_id", "mass") == pytest.approx({1: .6, 2: .2, 3: .2})
    broken = bridge.where("role_id <> 5").unionByName(spark.createDataFrame([(5, 99)], bridge.schema))
    checks = as_map(tx.taxonomy_verify(roles, vocab, tracks, broken, bridge, {"roles": 5}), "check", "n_bad")
    assert checks["unknown_tags"] == 1 and checks["only_in_levels"] == 1 and checks["only_in_bridge"] == 1 and checks["rows:roles"] == 0


def test_hubness(spark):
    texts = {1: [1., 0., 0., 0.], 2: [1., .4, 0., 0.], 3: [1., 0., .4, 0.], 4: [1., 0., 0., .4]}
    tags = {501 + i: [1. if j == i else 0. for j in range(4)] for i in range(4)}
    t = spark.createDataFrame([(k, v) for k, v in texts.items()], "text_id bigint, vec array<double>")
    g = spark.createDataFrame([(k, v) for k, v in tags.items()], "tag_id bigint, vec array<double>")
    assert as_map(hb.tag_text_corpus(t, g, 1), "text_id", "tag_id") == {1: 501, 2: 501, 3: 501, 4: 501}
    sims = hb.tag_similarities(t, g)
    z = as_map(hb.top_tags(hb.hubness_z(sims, hb.hubness_stats(sims)), 1), "text_id", "tag_id")
    assert (z[2], z[3], z[4]) == (502, 503, 504)
    blocked, plain = (as_map(df, "tag_id", "sd") for df in (hb.hubness_stats_blocked(t, g), hb.hubness_stats(sims)))
    assert blocked == pytest.approx(plain, abs=1e-7)
    rows = [[.9, .1], [.5, .3], [.1, .2]]
    s = spark.createDataFrame([(i, j, x) for i, r in enumerate(rows) for j, x in enumerate(r)], "text_id bigint, tag_id bigint, score double")
    csls = {(r.text_id, r.tag_id): r.score for r in hb.hubness_csls(s, 2).collect()}
    assert csls[(0, 0)] == pytest.approx(.9 - .35) and csls[(0, 1)] == pytest.approx(.1 - .125)
    centred = {(r.text_id, r.tag_id): r.score for r in hb.hubness_center(s, hb.hubness_stats(s)).collect()}
    dsm = {(r.text_id, r.tag_id): r.score for r in hb.hubness_dsm(s, 1e5).collect()}
    assert dsm == pytest.approx(centred, abs=1e-4)


def test_agreement(spark):
    pairs = spark.createDataFrame(list(zip([0, 0, 1, 1, 2, 2, 3, 3], [0, 1, 1, 1, 2, 3, 3, 3])), "a int, b int").withColumn("expected", F.col("b") * 1.0)
    r = ag.calibration_report(pairs).first()
    assert (r.exact, r.within_one, r.quadratic_kappa, r.kappa_ge2) == (.75, 1.0, .9, 1.0)
    cells = {(c.a, c.b): c.n for c in ag.confusion_matrix(pairs).collect()}
    assert len(cells) == 16 and cells[(0, 1)] == 1 and cells[(3, 3)] == 2 and cells[(3, 0)] == 0
    kappa = lambda a, b: ag.cohen_kappa(spark.createDataFrame(list(zip(a, b)), "a int, b int"), (0, 1)).first().kappa
    assert kappa([0, 1, 0, 1], [0, 1, 1, 0]) == pytest.approx(0) and kappa([0, 1], [1, 0]) == pytest.approx(-1)
    w = ag.proportion_ci(spark.createDataFrame([("x", True)] * 30, "g string, ok boolean"), ["g"], "ok").first()
    assert w.lo == pytest.approx(.8865, abs=1e-4) and w.hi == pytest.approx(1)
    rows = spark.createDataFrame([(s, i < 44) for s in ("in", "out") for i in range(70)], "s string, ok boolean")
    d = ag.proportion_difference(rows, "s", "in", "out", "ok").first()
    assert d.difference == 0 and d.hi == pytest.approx(.156, abs=1e-3)


def test_label_records(spark):
    schema = "seq int, top_logprobs array<struct<token:string,logprob:double>>"
    log = math.log
    rows = [(1, [("2", log(.3)), ("3", log(.1)), ("We", log(.5))]), (2, [("1", log(.2)), (" 1", log(.2)), ("0", log(.2))]), (3, [("We", -1.0)])]
    got = {r.seq: r for r in lb.grade_from_logprobs(spark.createDataFrame(rows, schema)).collect()}
    assert got[1].probs == [0, 0, .75, .25] and got[1].grade == 2 and got[2].probs[1] == pytest.approx(2 / 3, abs=1e-4) and got[3].status.startswith("error")
    texts = {"0.64": .64, "1": 1.0, ".5": .5, "1.5": None, "10": None, "score 0.07.": None, "none": None, "v 0.2 or 0.3": .2}
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("t", lb.score_from_text(F.col("t")).alias("s"))
    assert {r.t: r.s for r in df.collect()} == texts
    log_rows = [(1, 1, 1, "ok", 3, .9, [0., 0., .1, .9]), (2, 1, 2, "ok", 2, .6, [.2, .2, .6, 0.]), (3, 1, 3, "ok", 1, .3, [0., 1., 0., 0.]), (4, 1, 4, "ok", 0, .0, [1., 0., 0., 0.]),
                (5, 1, 5, "ok", 3, .9, [0., 0., 0., 1.]), (6, 1, 5, "ok", 0, .0, [1., 0., 0., 0.]), (7, 1, 6, "error: x", None, None, None)]
    recs = spark.createDataFrame(log_rows, "seq int, query_id bigint, doc_id bigint, status string, grade int, score double, probs array<double>")
    none = spark.createDataFrame([], "query_id bigint, doc_id bigint")
    truth = {(r.relevance, r.doc_id): r.gain for r in lb.truth_with_cutoffs(recs, none).collect()}
    assert {d: g for (rel, d), g in truth.items() if rel == "repro"} == {1: 100, 2: 67, 3: 33}
    assert truth[("p80", 2)] == 33 and truth[("p60", 2)] == 67
    mixed = recs.withColumn("prompt_version", F.concat(F.lit("v"), F.col("doc_id").cast("string")))
    with pytest.raises(Exception, match="more than one grader"):
        lb.single_grader_guard(mixed).collect()
    base = spark.createDataFrame([(1, 1, 0)], "query_id bigint, doc_id bigint, grade int")
    assert as_map(lb.merge_labels_first_wins(base, recs), value="grade") == {1: 0, 2: 2, 3: 1, 4: 0, 5: 3}
    assert lb.merge_counts(base, recs).first().asDict() == {"added": 4, "kept_existing": 2, "skipped_errors": 1}


def test_term_features(spark):
    one = spark.range(1)
    val = lambda e: one.select(e.alias("x")).first().x
    lit = F.lit
    assert [val(fits.budget_fit(lit(100.), lit(150.), lit(r))) for r in (120., 90., 160., 210.)] == pytest.approx([1, .8, .8, 0])
    assert val(fits.budget_fit(lit(100.), lit(100.), lit(100.5))) == .5
    assert [val(fits.seniority_fit(lit(a), lit(b))) for a, b in (("mid", "expert"), ("mid", "senior"), ("?", "mid"))] == [0, .5, .5]
    day = lit("2026-10-01").cast("date")
    avail = lambda a, s, text=None: val(fits.avail_immediacy(lit(a).cast("string"), lit(s).cast("string"), lit(text).cast("string"), day))
    assert avail("2026-10-31", "2026-10-01") == .5 and avail("2026-09-26", "2026-10-01") == 1 and avail("2026-12-30", "2026-10-01") == 0 and avail("now", "asap") == 1
    assert avail(None, None, "Free Weekday Evenings") == .6 and avail(None, None, "call me") == .5
    rows = spark.createDataFrame([(1, 1, 1.), (1, 2, 2.), (1, 3, 4.), (2, 1, 7.), (3, 1, 5.), (3, 2, 5.), (3, 3, 3.)], "query_id bigint, doc_id bigint, x double")
    z = {(r.query_id, r.doc_id): r.x for r in fe.normalize_by_query(rows, ["x"]).collect()}
    assert z[(1, 3)] == pytest.approx((4 - 7 / 3) / 1.247219, abs=1e-5) and z[(2, 1)] == 7
    rank = {(r.query_id, r.doc_id): r.x for r in fe.normalize_by_query(rows, ["x"], "rank").collect()}
    assert (rank[(3, 1)], rank[(3, 2)], rank[(3, 3)], rank[(2, 1)]) == (1, 1, .5, 7)


def test_text(spark):
    words = {"regulations": "regul", "regulatory": "regulate", "provisioning": "provision", "parties": "party", "executives": "executive",
             "monthly": "month", "based": "based", "nation": "nation", "process": "proces", "basis": "basi"}
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", stem(F.col("w")).alias("s"))
    assert {r.w: r.s for r in df.collect()} == words
    row = spark.createDataFrame([("a", "", None, "b")], "a string, b string, c string, d string").select(match_text("a", "b", "c", "d").alias("t")).first()
    assert row.t == "a b"


def test_bm25_zero_scores(spark):
    from ranklab.operators.bm25 import bm25_rank
    docs = spark.createDataFrame([(i, "", t) for i, t in enumerate(["red fox", "blue sky", "green tree", "red sea", "old car", "new house"])], "doc_id bigint, title string, body string")
    gigs = spark.createDataFrame([(1, "", "fox"), (2, "", "zebra")], "query_id bigint, title string, body string")
    out = bm25_rank(docs, gigs, 3, refined=False).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc_id) for r in out] == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2)]


def test_ranges_of_skewed_values_are_bounded(spark):
    """Nine in ten values within a thousandth of the range: positions are exact and no range holds much over its share."""
    from ranklab.operators import ordering
    from ranklab.session import checkpoint
    rows = [(i, i * 1e-6 if i % 10 else i * 1e3) for i in range(20_000)]
    df = spark.createDataFrame(rows, "id bigint, x double").repartition(8)
    got = {r.id: r.pos for r in ordering.global_rank(df, "x", "pos").collect()}
    assert got == {i: k for k, (i, _) in enumerate(sorted(rows, key=lambda r: r[1]), start=1)}
    ranges = checkpoint(df.repartitionByRange(8, "x").withColumn("bin", F.spark_partition_id()))
    assert max(r["count"] for r in ranges.groupBy("bin").count().collect()) < 2 * 20_000 / 8


def test_audit_item_ids_do_not_collide(spark):
    from ranklab.operators.pools import stratified_audit_sample
    records = spark.range(1500).select(F.col("id").alias("query_id"), F.col("id").alias("doc_id"), F.lit(2).alias("grade"))
    items = [r.item for r in stratified_audit_sample(records, [("all", F.col("grade") >= 0, 1500)]).collect()]
    assert len(set(items)) == 1500 and {"A001", "A999", "A1000", "A1500"} <= set(items)


def test_audit_strata_are_filled_one_after_another(spark):
    import hashlib
    import random
    from ranklab.operators.pools import stratified_audit_sample
    rng = random.Random(2)
    rows = list({(rng.randrange(30), rng.randrange(40)): rng.random() for _ in range(400)}.items())
    table = spark.createDataFrame([(q, d, 2, s) for (q, d), s in rows] + [(99, 1, 2, None)], "query_id bigint, doc_id bigint, grade int, score double")
    strata = [("low", lambda s: s < .5, 12), ("high", lambda s: s > .3, 11), ("any", lambda s: True, 4)]
    used = {p for p, _ in rows[::7]}
    taken, want = set(), set()
    for name, keep, quota in strata:
        left = sorted((hashlib.md5(f"7|audit|{q}|{d}".encode()).hexdigest(), q, d) for (q, d), s in rows if keep(s) and (q, d) not in used)
        for _, q, d in left:
            if quota and q not in taken:
                taken.add(q)
                want.add((q, d, name))
                quota -= 1
    columns = [("low", F.col("score") < .5, 12), ("high", F.col("score") > .3, 11), ("any", F.col("score") >= 0, 4)]
    before = spark.createDataFrame(list(used), "query_id bigint, doc_id bigint")
    got = {(r.query_id, r.doc_id, r.stratum) for r in stratified_audit_sample(table, columns, before).collect()}
    assert got == want and len(got) == 27
    with pytest.raises(ValueError, match="any: 7 of 9"):
        stratified_audit_sample(table, [*columns[:2], ("any", F.col("score") >= 0, 9)], before)


def test_run_stats_on_the_readers_log(spark, tmp_path):
    from ranklab.operators.labels import run_stats
    from ranklab.sources import readers as rd, sinks as sk
    marks = ["ok", "error", "error", "ok", "error"]
    log = spark.createDataFrame([(str(i), str(i), m) for i, m in enumerate(marks)], "hire_id string, provider_id string, status string").coalesce(1)
    sk.sink_log(log, str(tmp_path / "log"))
    read = rd.read_judgment_log(spark, str(tmp_path / "log"))
    wanted = spark.createDataFrame([(0, 0), (9, 9)], "query_id bigint, doc_id bigint")
    row = run_stats(wanted, read, read, abort_after=2).first()
    assert (row.requested, row.already_done, row.graded, row.errors, row.longest_error_streak, row.aborted) == (2, 1, 2, 3, 2, True)


def test_nan_does_not_poison_a_query(spark):
    from ranklab.operators.features import normalize_by_query
    rows = spark.createDataFrame([(1, 1.0), (1, 3.0), (1, float("nan")), (2, 5.0)], "query_id bigint, x double")
    got = sorted(((r.query_id, r.x) for r in normalize_by_query(rows, ["x"]).collect()), key=repr)
    assert got == sorted([(1, -1.0), (1, 1.0), (1, None), (2, 5.0)], key=repr)


def test_spread_uses_directions_only(spark):
    from ranklab.operators.metrics import embedding_spread, positive_cosine
    vectors = spark.createDataFrame([(1, [3.0, 0.0]), (2, [3.0, 0.0]), (3, [0.0, 0.0]), (4, [float("nan"), 1.0])], "doc_id bigint, vec array<double>")
    row = embedding_spread(vectors).first()
    assert (row.n, row.n_nan, row.mean_pairwise_cosine, row.collapsed) == (2, 1, 1.0, True)
    pair = spark.createDataFrame([(1, 2)], "anchor bigint, positive bigint")
    assert [tuple(r) for r in positive_cosine(pair, vectors, (2, 1)).orderBy("dim").collect()] == [(1, 1, 1.0), (2, 1, 1.0)]


def test_numbers_print_with_six_significant_digits(spark):
    from ranklab.operators.features import _number
    values = [0.0, 1.0, 12.5, 1234567.0, 999999.5, 0.0001, 0.00001234, 123456.0, -2.5, 1e10, 0.12345678, 100000.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(_number(F.col("x"))).collect()]
    assert got == ["%g" % v for v in values]


def test_scores_in_answers(spark):
    from ranklab.operators.labels import score_from_text
    cases = {"0.5": .5, "v1.2.3 then .75": .75, "12 0.1": .1, "1.5": None, "1": 1.0, "1.": None, "none": None, "": None, None: None, "a.b 0": 0.0}
    rows = spark.createDataFrame([(k,) for k in cases], "x string")
    assert {r.x: r.s for r in rows.select("x", score_from_text(F.col("x")).alias("s")).collect()} == cases


def test_bm25_ranks_of_negative_and_zero_scores(spark):
    """A full list is positive scores, then documents at 0 by id, then negative scores; heads and single ranks agree."""
    from ranklab.operators.bm25 import text_ranks, text_top
    rng = random.Random(4)
    docs = spark.createDataFrame([(3 * i,) for i in range(30)], "doc_id bigint")
    queries = spark.createDataFrame([(q,) for q in range(4)], "query_id bigint")
    score = {(q, 3 * i): round(rng.choice([-2.0, -1.0, 0.0, 1.0, 2.0]), 9) for q in range(3) for i in rng.sample(range(30), 10 + 6 * q)}
    table = spark.createDataFrame([(q, d, s) for (q, d), s in score.items()], "query_id bigint, doc_id bigint, score double")
    full = {q: sorted((3 * i for i in range(30)), key=lambda d: (-score.get((q, d), 0.0), d)) for q in range(4)}
    for k in (3, 12, 30):
        got = sorted((r.query_id, r.rank, r.doc_id) for r in text_top(table, queries, docs, k).collect())
        assert got == [(q, r, d) for q in range(4) for r, d in enumerate(full[q][:k], start=1)]
    pairs = spark.createDataFrame([(q, d) for q in range(4) for d in range(0, 90, 6)], "query_id bigint, doc_id bigint")
    assert {(r.query_id, r.doc_id): r.rank for r in text_ranks(table, docs, pairs).collect()} == {(q, d): full[q].index(d) + 1 for q in range(4) for d in range(0, 90, 6)}


def test_dense_ranks_of_pairs(spark):
    from ranklab.operators.similarity import ranks_of_pairs
    rng = random.Random(5)
    vec = lambda: [rng.choice([-1.0, 0.0, 1.0]) for _ in range(3)] + [1.0]
    left, right = {i: vec() for i in range(60)}, {q: vec() for q in range(5)}
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b)), 9)
    asked = [(d, q) for q in range(5) for d in range(q, 60, 3)]
    frame = lambda rows, name: spark.createDataFrame(list(rows.items()), f"{name} bigint, vec array<double>").repartition(3)
    got = ranks_of_pairs(frame(left, "doc_id"), frame(right, "query_id"), spark.createDataFrame(asked, "doc_id bigint, query_id bigint"), "doc_id", "query_id")
    full = {q: sorted(left, key=lambda d: (-cos(left[d], right[q]), d)) for q in right}
    assert {(r.doc_id, r.query_id): r.rank for r in got.collect()} == {(d, q): full[q].index(d) + 1 for d, q in asked}


def test_fusion_uses_ranks_below_the_head(spark):
    """A document at rank 60 of one list and 1 of the other gets both ranks, though the heads are 50 deep."""
    from ranklab.plans.stage1 import complete_lists
    order = list(range(1, 101))
    other = [60] + [d for d in order if d != 60]
    full = [{d: r for r, d in enumerate(o, start=1)} for o in (order, other)]
    head = lambda ranks: spark.createDataFrame([(1, d, r) for d, r in ranks.items() if r <= 50], "query_id bigint, doc_id bigint, rank bigint")
    lookup = lambda ranks: lambda pairs: pairs.join(spark.createDataFrame([(1, d, r) for d, r in ranks.items()], "query_id bigint, doc_id bigint, rank bigint"), ["query_id", "doc_id"])
    a, b = complete_lists([head(r) for r in full], [lookup(r) for r in full])
    got = fu.rrf_fuse2(a, b, top=3).orderBy("rank").collect()
    want = sorted(order, key=lambda d: (-round(1 / (60 + full[0][d]) + 1 / (60 + full[1][d]), 12), d))
    assert [r.doc_id for r in got] == want[:3] and a.where("doc_id = 60").first()["rank"] == 60


def test_draws_are_shared_by_tasks_and_never_broadcast(spark):
    """The same draws as plain Python's, made by several tasks, and no join that holds them in the driver's memory."""
    from collections import Counter
    from hashlib import md5
    from ranklab.operators import bootstrap as bs
    n, n_boot = 50, 20
    draws = bs.boot_draws(spark.range(100, 100 + n).withColumnRenamed("id", "unit"), "unit", n_boot, purpose="p")
    want = Counter((b, 100 + int(md5(f"7|p|{b}|{s}".encode()).hexdigest()[:15], 16) % n) for b in range(1, n_boot + 1) for s in range(1, n + 1))
    assert {(r.boot, r.unit): r.times for r in draws.collect()} == want
    assert "Broadcast" not in draws._jdf.queryExecution().executedPlan().toString()
    assert bs.draw_tasks(540_000, 2_000) >= 200
