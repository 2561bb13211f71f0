"""Operators over pages and vectors against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import hashlib
import random
import time
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ranklab.llm import catalog, common, embed_dedup, html_extract, url_filter, warc
from ranklab.session import scratch_path


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, host string")


# --- URLs ---

URLS = [
    ("http://A.Example.NET/en/x?q=/de/", "a.example.net", "/en/x", "example.net/en/", "allow"), ("http://example.net/english/", "example.net", "/english/", "net/", "block"),
    ("https://notexample.net/en/1", "notexample.net", "/en/1", "net/", "block"), ("x://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
    ("http://example.com/de", "example.com", "/de", None, "allow"), ("http://b.org/fr/1#/de/", "b.org", "/fr/1", "org/fr/", "allow"), ("http://net", "net", "", None, "allow"),
    ("http://c.net?x=/", "c.net", "", None, "allow"), ("http://c.net#/", "c.net", "", None, "allow"), ("no scheme /en/", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
    ("a://b.com/x://c.net/en/", "b.com", "/x://c.net/en/", None, "allow"), ("http://É.ORG/fr/é\nx", "É.org", "/fr/é\nx", "org/fr/", "allow"), ("://d.net/", "d.net", "/", "net/", "block")]


def test_hosts_paths_and_rules(spark):
    rows = [(i, u, None) for i, (u, *_) in enumerate(URLS)] + [(0, URLS[0][0], None), (None, URLS[0][0], "")]
    got = url_filter.judge_urls(pages_of(spark, rows), catalog.URL_RULES).collect()
    assert len(got) == len(rows)
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert {i: by[i] for i in range(len(URLS))} == {i: tuple(x[1:]) for i, x in enumerate(URLS)}
    assert by[None] == by[0] and url_filter.judge_urls(pages_of(spark, rows).limit(0), catalog.URL_RULES).count() == 0


def test_the_first_of_equally_long_rules_wins(spark):
    pages = pages_of(spark, [(1, "http://a.b/xx", None), (2, "http://z.a.b/x", None)])
    for kinds in (("allow", "block"), ("block", "allow")):
        rules = (url_filter.UrlRule(kinds[0], "a.b/x"), url_filter.UrlRule(kinds[1], "a.b/x"), url_filter.UrlRule(kinds[1], "a.b/"))
        assert {(r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules).collect()} == {("a.b/x", kinds[0])}


def brute_ranks(links, trusted, blocked, rounds=200, d=0.85):
    out = []
    for seeds, edges in ((trusted, links), (blocked, [(b, a, n) for a, b, n in links])):
        total = {}
        for a, _, n in edges:
            total[a] = total.get(a, 0) + n
        start = {h: 1 / len(seeds) for h in seeds}
        rank = dict(start)
        for _ in range(rounds):
            new = {h: (1 - d) * r for h, r in start.items()}
            for a, b, n in edges:
                if a in rank:
                    new[b] = new.get(b, 0) + d * rank[a] * n / total[a]
            rank = new
        out.append(rank)
    return out


def test_trust_and_distrust_spread_over_links(spark):
    rng = random.Random(1)
    hosts = [f"h{i}.com" for i in range(12)] + ["good.example.net", "bad.net"]
    rows, links = [], {}
    for i, host in enumerate(hosts * 3):
        path = "/en/" if host.startswith("good") else "/x/"
        to = [rng.choice(hosts) for _ in range(3)]
        for t in to:
            if t != host:
                links[host, t] = links.get((host, t), 0) + 1
        html = "".join(f'<a class=x href="{rng.choice(["http:", "HTTPS:", ""])}//{t.upper()}/p?q">t</a><a href="/local">l</a>' for t in to)
        rows.append((i, f"http://{host}{path}{i}", html))
    got = {r.host: r for r in url_filter.judge_urls(pages_of(spark, rows), catalog.URL_RULES).collect()}
    trust, distrust = brute_ranks([(a, b, n) for (a, b), n in links.items()], ["good.example.net"], ["bad.net"])
    for host in hosts:
        assert got[host].trust == pytest.approx(trust.get(host, 0), abs=1e-6) and got[host].distrust == pytest.approx(distrust.get(host, 0), abs=1e-6)
        if host.endswith(".com"):
            assert got[host].verdict == ("block" if distrust.get(host, 0) > trust.get(host, 0) else "allow")
    assert {got[h].verdict for h in hosts if h.endswith(".com")} == {"allow", "block"}


def test_ranks_go_on_until_they_settle(spark):
    # A chain of 30 hosts: the last is reached in round 30 only.
    links = spark.createDataFrame([(f"h{i}", f"h{i + 1}", 1.0) for i in range(30)], "src string, dst string, links double")
    seeds = spark.createDataFrame([("trust", "h0"), ("distrust", "h30")], "kind string, host string")
    got = {(r["kind"], r.host): r["rank"] for r in url_filter.propagate(links, seeds).collect()}
    for i in range(31):
        want = 0.15 * 0.85 ** i
        assert got["trust", f"h{i}"] == pytest.approx(want, rel=1e-9) and got["distrust", f"h{30 - i}"] == pytest.approx(want, rel=1e-9)


def test_small_distrust_decides(spark):
    chain = ["bad.net", *(f"h{i}.com" for i in range(5))]
    rows = [(i, f"http://{h}/x", f"<a href='http://{chain[i - 1]}/'>x</a>" if i else None) for i, h in enumerate(chain)]
    rows.append((9, "http://fat.com/x", "".join(f"<a href='http://{h}/'>x</a>" for h in chain for _ in range(999))))
    got = {r.host: r for r in url_filter.judge_urls(pages_of(spark, rows), catalog.URL_RULES).collect()}
    assert got["h4.com"].distrust == 0.0 and {got[h].verdict for h in chain} == {"block"}


# --- HTML ---

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{x:"</p>"}</style><script>var t="</article>";</script></head><body class="header">
<nav><ul><li><a href=/a>Menu</a></ul></nav><!-- <p>no</p> --><div class="ad">Buy</div><header>Top</header>
<article><h1>A &amp; B&nbsp;&lt;c&gt;</h1><p><b>One
 two<br>three<p>Four &#233;&copy;<aside>no</aside> five</p><div id='cookie-notice'>no</div><section class="reader-comments"><p>no</p></section>
<table><tr><td>x<td>y</table><form><p>no</form><ul><li>i<li>ii</ul><p title="a > b">six <i>seven</i>eight</article>
<footer>&copy; no</footer>"""


def test_blocks_of_a_page():
    texts, zones = html_extract.blocks_of(PAGE)
    assert html_extract.main_text(texts, zones, set()) == "A & B <c>\n\nOne two three\n\nFour é©\n\nfive\n\nx\n\ny\n\ni\n\nii\n\nsix seveneight"
    for html in ("", "plain", "<p>a<p>b", "<article>open <b>never closed", "<!-- never closed", "<script>never closed", "</p></div>x", "<a href=\"x>y", "<", "<>", "&am"):
        html_extract.blocks_of(html)
    assert html_extract.blocks_of("a &lt;b&gt; c")[0] == ["a <b> c"]


def page_text(html):
    texts, zones = html_extract.blocks_of(html)
    return html_extract.main_text(texts, zones, set()).split("\n\n")


def test_odd_quotes_lose_no_text():
    assert page_text('<article><p>one <a ">two</a> three</p><p>four <b title="x">five</b></p></article>') == ["one two three", "four five"]
    assert page_text("<article><p>one <a x'y\" b='q>r'>two</a> three<p it's>four") == ["one two three", "four"]
    # Never closed: a letter. Closed further on: the value goes up to there, as in HTML.
    assert page_text('<article><p>one <a href="x>two</a> three</p><p>four') == ["one two three", "four"]
    assert page_text('<article><p>one <a href="x>two</a> <a href="y">three') == ["one three"]
    assert page_text("<article><p title='class=ad'>one<p data-class=ad>two<p class = 'ad' >no<p CLASS=ad>no</article>") == ["one", "two"]
    assert page_text("<article><p a=>one<br/>two<p =\"x>three<p/ /a / b = c>four") == ["one two", "three", "four"]


def test_depth_costs_nothing():
    html = "<article>" + "<div><b>" * 30_000 + "x" + "</b></div>" * 30_000
    start = time.perf_counter()
    assert page_text(html) == ["x"] and time.perf_counter() - start < 5


def test_partitions_grow_with_the_files(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    spark.range(20_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x")).coalesce(1).write.parquet(path)
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert common.partitions_for(spark.read.parquet(path)) == usual
    monkeypatch.setattr(common, "PARTITION_BYTES", 10_000)
    assert common.partitions_for(spark.read.parquet(path)) > max(usual, 50)


def brute_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_shared_blocks_are_a_longest_common_subsequence():
    rng = random.Random(9)
    for _ in range(300):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(0, 14))] for _ in range(2))
        shared = sorted(html_extract.shared_blocks(a, b))
        rest = iter(b)
        assert len(shared) == brute_lcs(a, b) and all(a[i] in rest for i in shared)


def brute_text(rows):
    """Main texts by page id, neighbours found by sorting everything."""
    def split(url):
        rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
        host = rest.split("/")[0].split("?")[0].split("#")[0]
        return host.lower(), rest[len(host):].split("?")[0].split("#")[0]

    keyed = sorted(((*split(u), p is not None, p or 0), p, html_extract.blocks_of(h or "")) for p, u, h in rows)
    out = {}
    for k, (key, page, (texts, zones)) in enumerate(keyed):
        near = [keyed[j] for j in (k - 1, k + 1) if 0 <= j < len(keyed) and keyed[j][0][0] == key[0]]

        def common(x):
            n = 0
            while n < min(len(x[0][1]), len(key[1])) and x[0][1][n] == key[1][n]:
                n += 1
            return n

        best = max(near, key=common, default=None)
        shared = html_extract.shared_blocks(texts, best[2][0]) if best else set()
        out[page] = (html_extract.main_text(texts, zones, shared), len(shared))
    return out


@pytest.mark.parametrize("partitions", ["1", "4", "13"])
def test_nearest_page_differencing(spark, partitions):
    rng = random.Random(6)
    rows = []
    for i in range(60):
        own = [f"<p>own {i} {k}</p>" for k in range(3)]
        frame = "<div>Welcome to the site</div>{}<div>All rights reserved</div><p>About us</p>"
        body = frame.format(f"<article>{''.join(own)}<p>licence</p></article>" if i % 3 == 0 else "".join(own))
        rows.append((i, f"http://h{i % 2}.com/{rng.choice('ab')}/{rng.randint(0, 30)}", f"<html><body>{body}</body></html>"))
    rows += [(100, None, "<p>x"), (101, "http://h1.com/a/", None), (102, "no scheme", "<p>x"), (None, "http://h1.com/a/1", "<p>null id</p>"), (103, "http://alone.com/", "<div>Welcome to the site</div>")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r.page_id: (r.text, r.n_shared) for r in html_extract.extract_text(pages_of(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute_text(rows)
    assert got[0][0] == "own 0 0\n\nown 0 1\n\nown 0 2\n\nlicence" and got[1][0] == "own 1 0\n\nown 1 1\n\nown 1 2"
    assert got[103][0] == "Welcome to the site" and got[101][0] == ""


def test_names_of_several_words_need_a_neighbour_that_shares_them(spark):
    names = ('<section id="related-work"><p>{0} related work</p></section><h2 id="search-methods">{0} methods</h2><h2 class="header">{0} title</h2>'
             '<div class="share-prices">{0} prices</div><div class="menu">{0} dishes</div><div class="ad-slot">Buy now</div><div class="notice">We use them</div>'
             '<div class="ad">{0} advert</div><aside>{0} aside</aside><div data-id="share">{0} data</div>')
    page = f'<div class="search-page"><p>{{0}} lead</p></div><div class="ad">{{0}} top</div><p>Site</p><article>{names}</article><p>{{0}} tail</p>'
    rows = [(i, f"http://a.com/{i}", page.format(x)) for i, x in enumerate(("one", "two"))]
    rows.append((2, "http://alone.com/", page.format("three")))
    got = {r.page_id: r.text.split("\n\n") for r in html_extract.extract_text(pages_of(spark, rows)).collect()}
    kept = ("lead", "related work", "methods", "title", "prices", "dishes", "data", "tail")
    for i, x in enumerate(("one", "two")):
        assert got[i] == [f"{x} {k}" for k in kept]
    assert got[2] == ["three lead", "Site", "three related work", "three methods", "three title", "three prices", "Buy now", "three data", "three tail"]


def test_html_of_empty_and_repeated_pages(spark):
    same = [(1, "http://a.com/x", "<p>same</p>")] * 5
    got = html_extract.digest(pages_of(spark, same)).collect()
    assert len(got) == 5 and {(r.text, r.n_chars) for r in got} == {("", 0)}
    assert html_extract.digest(pages_of(spark, same).limit(0)).count() == 0


# --- vectors ---

def brute_vectors(rows, cosine=0.93):
    units = {k: (embed_dedup.unit(v), label) for k, (_, v, label) in enumerate(rows)}
    links, root = {k: 0 for k in units}, {k: k for k in units}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(units, 2):
        (u, x), (v, y) = units[a], units[b]
        if u is not None and v is not None and len(u) == len(v) and x is not None and x == y and float(u @ v) >= cosine:
            links[a] += 1
            links[b] += 1
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {rows[k][0]: (links[k], rows[find(k)][0], find(k) == k) for k in units}


def vector_rows(seed):
    rng = np.random.default_rng(seed)
    rows = []

    def add(v, label):
        rows.append((len(rows), [float(x) for x in v], label))

    for label in (0, 1, 2):
        for _ in range(60):
            add(rng.normal(size=8), label)
        centre = rng.normal(size=8)
        for _ in range(120 if label == 0 else 10):
            add(centre / np.linalg.norm(centre) + rng.normal(size=8) * rng.choice([0.02, 0.08, 0.12]), label)
    for k in range(30):
        add([np.cos(k * 0.3), np.sin(k * 0.3)], 5)
    for v, label in (([0.0] * 8, 0), ([float("nan")] + [1.0] * 7, 0), ([float("inf")] + [1.0] * 7, 0), ([1e-300] * 8, 0), ([1e300] * 8, 0), ([1.0] * 8, None), ([1.0] * 8, 9), ([], 0)):
        add(v, label)
    rows.append((len(rows), None, 1))
    rows.append((len(rows), [None, 1.0], 5))
    return rows


@pytest.mark.parametrize("cell_rows", [4096, 16])
def test_near_vectors_equal_brute_force(spark, cell_rows):
    rows = vector_rows(cell_rows)
    df = spark.createDataFrame([(*r, 1, "h") for r in rows], "vec_id long, embedding array<double>, label int, id int, unit string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_vectors(df, cell_rows=cell_rows).collect()}
    assert got == brute_vectors(rows)
    assert max(n for n, _, _ in got.values()) > 60


def test_near_vectors_of_odd_tables(spark):
    kind = "vec_id long, embedding array<double>, label int"
    assert embed_dedup.digest(spark.createDataFrame([], kind)).count() == 0
    odd = spark.createDataFrame([(None, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [2.0, 0.0], 1)], kind)
    assert sorted((tuple(r) for r in embed_dedup.digest(odd).collect()), key=repr) == sorted([(None, 0, None, True), (3, 1, 3, True), (4, 1, 3, False)], key=repr)


# --- WARC ---

def warc_pages(spark):
    rows = [(i, f"http://a.com/{i}", "é" * i + "WARC/1.0\r\n\r\n") for i in range(50)] + [(60, None, "x"), (61, "u", None), (62, "", ""), (None, "n", "null id"), (62, "", "")]
    return pages_of(spark, rows)


def test_warc_files_round_trip(spark):
    records = warc.to_records(warc_pages(spark), archive_records=16)
    path = scratch_path(spark, "test-warc")
    warc.write_warc(records, path)
    stored = warc.read_warc(spark, path)
    key = lambda r: (r.archive, bytes(r.record))
    want = sorted((r.archive, r.record.encode()) for r in records.collect())
    assert sorted(map(key, stored.collect())) == want
    audit = warc.audit_records(records, stored).collect()
    assert len(audit) == 55 and {r.status for r in audit} == {"ok"} and len({r.archive for r in audit}) > 4
    one = next(r for r in audit if r.page_id == 3)
    assert hashlib.sha256(next(r.record for r in records.collect() if r.page_id == 3).encode()).hexdigest() == one.record_sha256


def brute_root(digests, levels, fanout):
    for _ in range(levels):
        digests = [hashlib.sha256("".join(digests[k:k + fanout]).encode()).hexdigest() for k in range(0, len(digests), fanout)]
    return digests


def test_audit_finds_damage_and_loss(spark):
    records = warc.to_records(warc_pages(spark), archive_records=64)
    plain = warc.leaves(records)
    stored = records.join(plain.select("page_id", "archive", "offset", "length"), ["page_id", "archive"]).filter("page_id is not null and page_id <> 62")
    hurt = stored.filter("page_id <> 7").withColumn("record", F.when(F.col("page_id") == 20, F.concat(F.lit("x"), "record")).otherwise(F.col("record")))
    got = {r.page_id: r for r in warc.audit_records(records, hurt).collect()}
    assert {i for i, r in got.items() if r.status == "corrupt"} == {20}
    assert {i for i, r in got.items() if r.status == "missing"} == {7, 62, None}
    leaf = [r.digest for r in plain.filter("page_id is not null").orderBy("ordinal").collect()]
    assert [got[0].archive_root] == brute_root(leaf, warc.LEAST_LEVELS, warc.FANOUT)
    tree = warc.merkle_levels(plain, 4)
    assert warc.audit(tree, tree).count() == 0
    assert warc.audit_records(records.limit(0), hurt).count() == 0


def test_records_of_a_file_cut_short():
    whole = b"WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\ncontent-length: 5\r\n\r\nab"
    assert [whole[a:b] for a, b in warc.record_spans(whole)] == [whole[:34], whole[38:]]
    assert list(warc.record_spans(b"")) == []


def test_url_oracle_agrees_on_linked_hosts(spark, tmp_path):
    import duckdb

    rng = random.Random(11)
    hosts = [f"h{i}.com" for i in range(8)] + ["a.example.net", "b.net"]
    rows = [(i, f"http://{h}/{'en' if h[0] == 'a' else 'x'}/{i}", "".join(f"<a href='https://{rng.choice(hosts)}/'>x</a>" for _ in range(3))) for i, h in enumerate(hosts * 2)]
    pages = pages_of(spark, rows)
    pages.write.parquet(f"{tmp_path}/pages")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages/*.parquet'")
    columns = ["page_id", "host", "path", "rule", "verdict", "trust", "distrust"]
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({url_filter.oracle(catalog.URL_RULES, 120)}) ORDER BY page_id").fetchall()
    got = [tuple(r[c] for c in columns) for r in url_filter.judge_urls(pages, catalog.URL_RULES).orderBy("page_id").collect()]
    assert [g[:5] for g in got] == [w[:5] for w in want] and max(r[6] for r in got) > 0
    assert [g[5:] for g in got] == [pytest.approx(w[5:], abs=1e-9) for w in want]
