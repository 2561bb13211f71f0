"""Secrets in texts, found through a trigram index.

Each rule is a regular expression. From its syntax tree comes a Boolean query over trigrams that every match must
contain (AND along a sequence, OR over alternatives). Every block of documents gets an inverted index of the trigrams
that the rules ask for: postings of documents per trigram, as bit rows. A rule's query over the postings names the
candidates, and only these are verified with the expression itself. A rule without mandatory trigrams scans all texts.
The index is partitioned by documents, so no text is shuffled and a common trigram is split over all blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import astuple, dataclass
from itertools import product
from re import _constants as op, _parser as tree

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ranklab.llm.common import per_batch

#: Most literal strings kept for one part of an expression, and most members of a class that count as literals.
MAX_STRINGS = 64
MAX_CLASS = 8


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches whose `group` is shorter than `least` are dropped after matching, as matches."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    any_case: bool = False


#: The three base kinds, in the order in which equal starts are listed.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    # Runs of 24 or more are the matches of [0-9a-f]+ of that length: a match takes a whole run.
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
#: Further kinds.
MORE = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)

#: A query is None (everything), or ("and" | "or", frozenset of trigrams and queries).
Query = tuple | None


def _both(a: Query, b: Query) -> Query:
    if a is None or b is None or a == b:
        return a if b is None else b
    return ("and", frozenset((a, b)))


def _demand(strings: Iterable[str]) -> Query:
    """The trigrams that a text holding one of `strings` must have."""
    options = []
    for text in set(strings):
        grams = frozenset(text[i:i + 3] for i in range(len(text) - 2))
        if not grams:
            return None
        options.append(("and", grams))
    return options[0] if len(options) == 1 else ("or", frozenset(options)) if options else None


def _walk(parts) -> tuple[set[str] | None, Query]:
    """Of a sequence: the lower-cased strings it is one of (None: it may be others), and the query of what was cut off.
    A string has one character per UTF-8 byte, like the index."""
    run: set[str] = {""}
    asked: Query = None
    whole = True
    for kind, value in parts:
        strings, inner = _part(kind, value)
        asked = _both(asked, inner)
        joined = None if strings is None else {a + b for a, b in product(run, strings)}
        if joined is not None and len(joined) <= MAX_STRINGS:
            run = joined
        else:
            asked = _both(asked, _demand(run))
            run = {""} if strings is None else strings
            whole = False
    return (run, asked) if whole else (None, _both(asked, _demand(run)))


def _letter(code: int) -> str:
    """A literal as the index sees it: the bytes of its UTF-8 form, A-Z lowered, nothing else folded."""
    return chr(code).encode("utf-8", "surrogatepass").lower().decode("latin-1")


def _part(kind, value) -> tuple[set[str] | None, Query]:
    if kind is op.LITERAL:
        return {_letter(value)}, None
    if kind is op.IN:
        members = set()
        for what, x in value:
            if what is op.LITERAL:
                members.add(_letter(x))
            elif what is op.RANGE and x[1] - x[0] < MAX_CLASS:
                members.update(_letter(c) for c in range(x[0], x[1] + 1))
            else:
                return None, None
        return (members, None) if len(members) <= MAX_CLASS else (None, None)
    if kind is op.SUBPATTERN:
        return _walk(list(value[3]))
    if kind is op.BRANCH:
        sides = [_walk(list(x)) for x in value[1]]
        if all(s is not None and q is None for s, q in sides):
            strings = set().union(*(s for s, _ in sides))
            if len(strings) <= MAX_STRINGS:
                return strings, None
        options = [_both(q, _demand(s) if s is not None else None) for s, q in sides]
        return None, None if None in options else ("or", frozenset(options))
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        low, high, inner = value
        strings, asked = _walk(list(inner))
        if (low, high) == (0, 1) and strings is not None and asked is None:
            return strings | {""}, None
        if low == 0:
            return None, None
        if low == high == 1:
            return strings, asked
        return None, _both(asked, _demand(strings) if strings is not None else None)
    if kind is op.AT:
        return {""}, None
    return None, None


def trigram_query(pattern: str) -> Query:
    """Boolean query over trigrams of UTF-8 bytes (A-Z lowered) that holds for every text with a match of `pattern`."""
    strings, asked = _walk(list(tree.parse(pattern)))
    return _both(asked, _demand(strings) if strings is not None else None)


def asked_trigrams(query: Query) -> set[str]:
    if query is None:
        return set()
    return set().union(*({x} if isinstance(x, str) else asked_trigrams(x) for x in query[1]))


class TrigramIndex:
    """The index of a block of texts, for the trigrams that some rule asks for."""

    def __init__(self, grams: list[str]) -> None:
        self.row = {g: i for i, g in enumerate(grams)}
        self.of_code = np.zeros(1 << 24, dtype=np.uint16)
        for i, gram in enumerate(grams):
            a, b, c = gram.encode("latin-1")
            self.of_code[a << 16 | b << 8 | c] = i + 1

    def build(self, texts: list[bytes]) -> np.ndarray:
        """Postings as bit rows: [trigram, text]."""
        postings = np.zeros((len(self.row) + 1, len(texts)), dtype=bool)
        data = np.frombuffer(b"\n".join(texts).lower() + b"\n\n\n", dtype=np.uint8)
        starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])[:-1])) if texts else np.zeros(0, dtype=np.int64)
        for low in range(0, len(data) - 2, 1 << 22):
            piece = data[low:low + (1 << 22) + 2].astype(np.int32)
            row = self.of_code[piece[:-2] << 16 | piece[1:-1] << 8 | piece[2:]]
            at = np.flatnonzero(row)
            postings[row[at], np.searchsorted(starts, at + low, side="right") - 1] = True
        return postings[1:]

    def candidates(self, query: Query, postings: np.ndarray) -> np.ndarray:
        if query is None:
            return np.ones(postings.shape[1], dtype=bool)
        rows = [postings[self.row[x]] if isinstance(x, str) else self.candidates(x, postings) for x in query[1]]
        return (np.logical_and if query[0] == "and" else np.logical_or).reduce(rows)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = rules
        self.found = [re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.any_case else 0)).finditer for r in rules]
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.index = TrigramIndex(sorted(set().union(*map(asked_trigrams, self.queries))))

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Per text its spans (start, number of the rule, end), sorted."""
        postings = self.index.build([t.encode() for t in texts])
        spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, finditer, query) in enumerate(zip(self.rules, self.found, self.queries)):
            for i in np.flatnonzero(self.index.candidates(query, postings)).tolist():
                for m in finditer(texts[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        spans[i].append((m.start(), k, m.end()))
        for found in spans:
            found.sort()
        return spans


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row its id and `secrets`: (kind, start, end) of every secret of the whole text, code points with the end
    exclusive, by start and then by the order of the rules.

    Within one kind matches are the leftmost that do not overlap; kinds may overlap. Null and empty texts have none.
    Ids may be null or repeated: rows are scanned one by one and all come back.
    """
    # Plain values: workers need not have this package to read a broadcast.
    shared = docs.sparkSession.sparkContext.broadcast({"rules": [astuple(r) for r in rules]})

    def work(batch):
        state = shared.value
        if "scanner" not in state:
            state["scanner"] = Scanner(tuple(Rule(*r) for r in state["rules"]))
        scanner = state["scanner"]
        texts = [t or "" for t in batch.column("_text").to_pylist()]
        return {"secrets": [[{"kind": scanner.rules[k].kind, "start": a, "end": b} for a, k, b in found] for found in scanner.scan(texts)]}

    kind = docs.schema[id_col].dataType.simpleString()
    return per_batch(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), ["_id", "_text"],
                     f"_id {kind}, secrets array<struct<kind: string, start: long, end: long>>", work).withColumnRenamed("_id", id_col)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is(kind: str):
    return lambda x: x == kind


def digest(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans, per document."""
    found = find_secrets(docs)
    kinds = [r.kind for r in BASE]
    base = F.filter("secrets", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(F.filter(F.transform("secrets", lambda s: s["kind"]), _is(k))).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("secrets")).alias("spans"))
