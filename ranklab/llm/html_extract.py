"""Main text of pages by nearest-URL page differencing.

Pages of a host stand in the order of their paths; each is paired with the neighbour whose path shares the longer
beginning, the two sequences of text blocks are aligned by longest common subsequence, and what both share is template.
Articles do repeat lines of their neighbours, and menus or adverts do differ between pages, so structure has the last
word where it speaks: blocks of an article stay, blocks of menus, footers, forms and the like go, and all others stay
unless they are shared. A name of several words, like `share-prices`, only raises a doubt, which sharing confirms.

Neighbours are exact however the pages are partitioned: the first pass learns the border pages of a range partitioning,
and a border page is also sent to the partition next door.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ranklab.llm.common import bounded_rows, partitions_for
from ranklab.llm.url_filter import host_of, path_of

#: Elements whose text is never main text, and words of class, id and role attributes that say so.
SILENT = frozenset("nav header footer aside form script style noscript template head title select button textarea iframe svg dialog menu object canvas".split())
RAW = frozenset("script style noscript template textarea title iframe svg".split())
SILENT_WORDS = frozenset((
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disclaimer "
    "footer form header login masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted promotion related "
    "replies reply search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar complementary contentinfo").split())
#: Of these, those whose text is new on every page, so that no neighbour could confirm it.
OWN_WORDS = frozenset("ad ads advert advertisement adverts comment comments commentlist promo promoted promotion related replies reply sponsor sponsored".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCK = frozenset((
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul").split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag ends an open element of these kinds.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Attributes as HTML reads them: a quote counts only where a value starts, one that is never closed is a letter, and a
#: stray quote belongs to a name. Without these a tag would run on beyond its `>`.
VALUE = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))?"""
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[\s/]++|[^\s/>][^\s/>=]*+(?>" + VALUE.replace("([^", "(?:[^") + r")?+)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?>" + VALUE + ")?+")
WORD = re.compile(r"[a-z]+")
#: What structure says of a block. LIKELY and DOUBT are named like template and go if the neighbour shares them; with no
#: neighbour to ask, LIKELY goes and DOUBT stays.
GONE, OPEN, MAIN, LIKELY, DOUBT = 0, 1, 2, 3, 4
_WORST = (GONE, LIKELY, DOUBT)


def _named(tag: str, attributes: str, article: bool) -> int | None:
    """What an element and its names say: GONE, LIKELY, DOUBT, or None. Ids of headings and sections are titles."""
    if tag in SILENT:
        return GONE
    if not attributes or tag in ("html", "body", "article", "main"):
        return None
    found = set()
    for m in ATTRIBUTE.finditer(attributes):
        name = m.group(1).lower()
        if name not in ("class", "id", "role") or name == "id" and (tag in HEADINGS or tag == "section"):
            continue
        for token in "".join(x or "" for x in m.groups()[1:]).split():
            words = WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower())
            if SILENT_WORDS.isdisjoint(words):
                continue
            if tag in HEADINGS:
                found.add(DOUBT)
            elif SILENT_WORDS.issuperset(words) and not (article and OWN_WORDS.isdisjoint(words)):
                found.add(GONE)
            else:
                found.add(LIKELY if words[-1] in SILENT_WORDS else DOUBT)
    return next((k for k in _WORST if k in found), None)


def blocks_of(html: str) -> tuple[list[str], list[int]]:
    """Text blocks of a page in order, and for each whether structure says GONE, LIKELY, DOUBT, OPEN (nothing) or MAIN (article)."""
    texts: list[str] = []
    zones: list[int] = []
    parts: list[str] = []
    # Open elements with the zone around each, and the places in the stack of every tag and of the block elements: no
    # tag looks through the stack, so depth costs nothing.
    stack: list[tuple[str, int]] = []
    places: dict[str, list[int]] = {}
    in_blocks: list[int] = []
    zone = OPEN

    def flush() -> None:
        text = " ".join(unescape("".join(parts)).split())
        parts.clear()
        if text:
            texts.append(text)
            zones.append(zone)

    def close() -> int:
        tag, around = stack.pop()
        places[tag].pop()
        if tag in BLOCK:
            in_blocks.pop()
        return around

    at, n = 0, len(html)
    while at < n:
        m = TAG.search(html, at)
        if m is None:
            parts.append(html[at:])
            break
        parts.append(html[at:m.start()])
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            if places.get(tag):
                depth = places[tag][-1]
                if in_blocks and in_blocks[-1] >= depth or stack[depth][1] != zone:
                    flush()
                while len(stack) > depth:
                    zone = close()
            elif tag in BLOCK:
                flush()
            continue
        if tag == "br":
            parts.append(" ")
        if tag in BLOCK:
            flush()
            ended = ENDS.get(tag, ())
            while stack and (stack[-1][0] in ended or stack[-1][0] == "p" or stack[-1][0] not in BLOCK and places.get("p") and stack[-1][0] not in SILENT):
                zone = close()
        if tag in VOID or m.group(3).endswith("/") and tag not in BLOCK:
            continue
        named = _named(tag, m.group(3), bool(places.get("article"))) if zone != GONE else None
        inner = next((k for k in _WORST if k in (zone, named)), MAIN if tag == "article" else zone)
        if inner != zone:
            flush()
        places.setdefault(tag, []).append(len(stack))
        if tag in BLOCK:
            in_blocks.append(len(stack))
        stack.append((tag, zone))
        zone = inner
        if tag in RAW:
            end = re.compile(rf"</{tag}\b", re.I).search(html, at)
            at = end.start() if end else n
    flush()
    return texts, zones


def shared_blocks(a: list, b: list) -> set[int]:
    """Places in a of a longest common subsequence of a and b (Hunt and Szymanski, equal ends taken off first)."""
    low = 0
    while low < len(a) and low < len(b) and a[low] == b[low]:
        low += 1
    high = 0
    while high < len(a) - low and high < len(b) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    shared = set(range(low)) | set(range(len(a) - high, len(a)))
    where: dict = {}
    for j in range(low, len(b) - high):
        where.setdefault(b[j], []).append(j)
    ends: list[int] = []
    last: list[tuple | None] = []
    for i in range(low, len(a) - high):
        for j in reversed(where.get(a[i], ())):
            k = bisect_left(ends, j)
            node = (i, last[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                last.append(node)
            else:
                ends[k], last[k] = j, node
    node = last[-1] if last else None
    while node:
        shared.add(node[0])
        node = node[1]
    return shared


def main_text(texts: list[str], zones: list[int], shared: set[int], compared: bool = False) -> str:
    """Blocks of articles, and of the others those that are not shared. `compared` says that there was a neighbour; if
    there was none, LIKELY blocks go."""
    wanted = (OPEN, DOUBT, LIKELY) if compared else (OPEN, DOUBT)
    return "\n\n".join(t for i, (t, z) in enumerate(zip(texts, zones)) if z == MAIN or z in wanted and i not in shared)


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


def _key(host: str, path: str, page) -> tuple:
    return host, path, page is not None, page if page is not None else 0


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, `text` (blocks joined by two \\n; empty if there are none) and `n_shared`, the number of blocks of
    the page that its nearest neighbour shares.

    White space inside a block becomes one space, character references are decoded. A null html is empty; pages without
    a host, null urls among them, are neighbours of each other; equal distances go to the page before, and equal
    addresses stand by id, nulls first. Ids are numbers and may repeat: every row comes back. An element or comment that
    is never closed reaches to the end of its parent, or of the page.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), host_of(F.col(url_col)).alias("_host"),
                        path_of(F.col(url_col)).alias("_path"), F.col(html_col).alias("_html"))
    keys = rows.select("_host", "_path", "_id")
    # The borders: first and last page of each range. Their number is that of the partitions, which grows with the bytes.
    n = partitions_for(pages)
    ranges = bounded_rows(keys.repartitionByRange(n, "_host", "_path", F.col("_id").asc_nulls_first()).groupBy(F.spark_partition_id())
                          .agg(F.min(F.struct("_host", "_path", "_id")).alias("first"), F.max(F.struct("_host", "_path", "_id")).alias("last")), n, "ranges")
    order = sorted((_key(*r["first"]), _key(*r["last"])) for r in ranges)
    firsts, lasts = [x for x, _ in order], [x for _, x in order]
    kind = pages.schema[id_col].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("part", "extra", "host", "path", "id", "url", "texts", "zones")}
            for page, url, host, path, html in zip(*[c.to_pylist() for c in batch.columns]):
                texts, zones = blocks_of(html) if html else ([], [])
                key = _key(host, path, page)
                part = max(0, bisect_right(firsts, key) - 1)
                to = [(part, False)]
                if part + 1 < len(firsts) and key == lasts[part]:
                    to.append((part + 1, True))
                if part and key == firsts[part]:
                    to.append((part - 1, True))
                for where, extra in to:
                    for name, value in zip(out, (where, extra, host, path, page, url, texts, bytes(zones))):
                        out[name].append(value)
            kinds = [pa.int32(), pa.bool_(), pa.string(), pa.string(), batch.schema.field(0).type, pa.string(), pa.list_(pa.string()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(before, page, after) -> tuple | None:
            if page[1]:
                return None
            near = [x for x in (before, after) if x is not None and x[0] == page[0] and x[2] == page[2]]
            best = max(near, key=lambda x: _common(x[3], page[3]), default=None)
            shared = shared_blocks(page[6], best[6]) if best else set()
            return page[4], page[5], main_text(page[6], list(page[7]), shared, best is not None), len(shared)

        before = page = None
        for batch in batches:
            out = []
            for after in zip(*[c.to_pylist() for c in batch.columns]):
                if page is not None and (row := result(before, page, after)):
                    out.append(row)
                before, page = page, after
            yield _batch(out, batch.schema.field(4).type)
        if page is not None and (row := result(before, page, None)):
            yield _batch([row], None)

    parsed = rows.mapInArrow(parse, f"part int, extra boolean, host string, path string, id {kind}, url string, texts array<string>, zones binary")
    sorted_pages = parsed.repartitionById(len(firsts) or 1, F.col("part")).sortWithinPartitions("host", "path", F.col("id").asc_nulls_first())
    found = sorted_pages.mapInArrow(pair, f"id {kind}, url string, text string, n_shared long")
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_shared")


def _batch(rows: list[tuple], kind) -> pa.RecordBatch:
    ids, urls, texts, counts = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(ids, kind or pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array(counts, pa.int64())],
                                      names=["id", "url", "text", "n_shared"])


def digest(pages: DataFrame) -> DataFrame:
    return extract_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared")
