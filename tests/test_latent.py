"""The latent basis against numpy's SVD."""

import numpy as np
import pytest

from ranklab.operators import lsa


def world(spark, n_docs=60, n_tags=25, seed=3):
    rng = np.random.default_rng(seed)
    taste = rng.random((n_docs, 3)) @ rng.random((3, n_tags))
    pairs = [(int(d), int(t) * 7 - 30) for d, t in zip(*np.nonzero(taste > np.quantile(taste, .7)))]
    return pairs, spark.createDataFrame(pairs + pairs[:5], "doc_id bigint, tag_id bigint"), spark.range(n_docs + 4).withColumnRenamed("id", "doc_id")


def matrix(pairs, n_docs):
    tags = sorted({t for _, t in pairs})
    df = {t: sum(x == t for _, x in pairs) for t in tags}
    out = np.zeros((n_docs, len(tags)))
    for d, t in pairs:
        out[d, tags.index(t)] = np.log1p((n_docs - df[t] + .5) / (df[t] + .5))
    return tags, out


@pytest.mark.parametrize("rank", [1, 4, 25, 90])
def test_basis_equals_the_singular_vectors(spark, rank):
    pairs, table, docs = world(spark)
    tags, w = matrix(pairs, 64)
    basis = {r.tag_id: (r.idf, r.axis) for r in lsa.lsa_basis(table, docs, rank, tolerance=1e-10).collect()}
    assert sorted(basis) == tags
    got = np.array([basis[t][1] for t in tags])
    _, values, vt = np.linalg.svd(w, full_matrices=False)
    k = min(rank, int((values > 1e-9).sum()))
    assert got.shape == (len(tags), k) and np.allclose(got.T @ got, np.eye(k), atol=1e-8)
    assert np.allclose(np.linalg.norm(w @ got, axis=0), values[:k], atol=1e-6)
    if rank in (1, 4) or k == rank:
        assert np.allclose(np.abs((got * vt[:k].T).sum(axis=0)), 1, atol=1e-4)


def test_sweep_and_empty_tables(spark):
    pairs, table, docs = world(spark)
    queries = spark.createDataFrame([(1, pairs[0][1]), (1, pairs[9][1]), (2, 10 ** 6)], "query_id bigint, tag_id bigint")
    tags, w = matrix(pairs, 64)
    lists = lsa.lsa_sweep(table, docs, queries, (2, 90), 5).where("query_id = 1").collect()
    _, _, vt = np.linalg.svd(w, full_matrices=False)
    q = np.zeros(len(tags))
    for t in {pairs[0][1], pairs[9][1]}:
        q[tags.index(t)] = w[:, tags.index(t)].max()
    for dim in (2, 90):
        v = vt[:dim].T
        x, y = w[:60] @ v, q @ v
        norms = np.linalg.norm(x, axis=1) * np.linalg.norm(y)
        cos = np.where(norms > 0, x @ y / np.where(norms > 0, norms, 1), 0)
        want = sorted(cos, reverse=True)[:5]
        assert sorted((r.score for r in lists if r.dim == dim), reverse=True) == pytest.approx(want, abs=1e-5)
    assert lsa.lsa_basis(table.limit(0), docs, 5).count() == 0


def test_iteration_and_direct_axes_give_the_same_lists(spark, monkeypatch):
    pairs, table, docs = world(spark)
    queries = spark.createDataFrame([(1, pairs[0][1]), (1, pairs[9][1]), (2, pairs[5][1]), (3, 10 ** 6)], "query_id bigint, tag_id bigint")
    lists = lambda: sorted((r.dim, r.query_id, r["rank"], round(r.score, 5)) for r in lsa.lsa_sweep(table, docs, queries, (3, 90), 5).collect())
    direct = lists()
    monkeypatch.setattr(lsa, "QUERY_BYTES", 0)
    assert direct == lists()
    monkeypatch.setattr(lsa, "DIRECT_TAGS", 0)
    assert direct == lists() and {r[1] for r in direct} == {1, 2}
    tags, w = matrix(pairs, 64)
    basis = {r.tag_id: r.axis for r in lsa.lsa_basis(table, docs, 4, tolerance=1e-10).collect()}
    _, values, _ = np.linalg.svd(w, full_matrices=False)
    assert np.allclose(np.linalg.norm(w @ np.array([basis[t] for t in tags]), axis=0), values[:4], atol=1e-6)


def test_small_vocabularies_write_no_document_vectors(spark, monkeypatch):
    written = []
    monkeypatch.setattr(lsa, "checkpoint", lambda df, f=lsa.checkpoint: written.append(df.columns) or f(df))
    pairs, table, docs = world(spark)
    asked = table.selectExpr("doc_id AS query_id", "tag_id").where("query_id < 8")
    d, _ = lsa.lsa_vectors(table, docs, asked, 90)
    assert d.count() == len({p[0] for p in pairs}) and lsa.lsa_rank(table, docs, asked, 90).count() > 0
    assert ["doc_id", "vec"] not in written
