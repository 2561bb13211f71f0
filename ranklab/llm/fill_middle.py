"""Fill-in-the-middle training texts by block rotation inside one buffer.

A text is cut in three at borders of lines. The buffer `<P>prefix<M>middle<S>suffix` differs from the form that is wanted
only in the order of neighbouring blocks, and two neighbouring blocks change places when each is reversed and then both
together are. Undoing the rotations and taking the sentinels out restores the text byte for byte.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ranklab.llm.common import per_batch, utf8

FORMS = ("plain", "psm", "spm")


@dataclass(frozen=True)
class Recipe:
    """Percentages are of documents; `seed` goes before the id in the hash that draws cuts and form."""
    rate: int = 100
    spm_rate: int = 50
    seed: int = 7
    prefix: bytes = b"<P>"
    suffix: bytes = b"<S>"
    middle: bytes = b"<M>"

    def __post_init__(self) -> None:
        marks = (self.prefix, self.suffix, self.middle)
        for i, a in enumerate(marks):
            for j, b in enumerate(marks):
                if not a or (i != j and a in b) or any(b.endswith(a[:k]) for k in range(1, len(a))):
                    raise ValueError("no sentinel may be empty or part of another, and the beginning of none the end of one: else texts could not be restored")


@dataclass(frozen=True)
class Cut:
    form: str
    first: int
    second: int
    units: int


def unit_ends(text: bytes) -> list[int]:
    """Ends of the lines, each with its line break; the last may lack one."""
    ends = []
    at = text.find(b"\n")
    while at >= 0:
        ends.append(at + 1)
        at = text.find(b"\n", at + 1)
    if len(text) > (ends[-1] if ends else 0):
        ends.append(len(text))
    return ends


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four numbers below 2**32 from the seed and the id (a null id: nothing)."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * k:4 * k + 4], "big") for k in range(4))


def plan(text: bytes, doc_id: int | None, recipe: Recipe) -> Cut:
    """Form, ends of prefix and middle in bytes, and the number of lines."""
    ends = unit_ends(text)
    h1, h2, h3, h4 = draws(recipe.seed, doc_id)
    n = len(ends)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or h3 % 100 >= recipe.rate or any(m in text for m in (recipe.prefix, recipe.suffix, recipe.middle)):
        return Cut("plain", 0, 0, n)
    return Cut("spm" if h4 % 100 < recipe.spm_rate else "psm", ends[low - 1] if low else 0, ends[high - 1] if high else 0, n)


def rotate(buffer: bytearray, start: int, border: int, stop: int) -> int:
    """buffer[start:border] and buffer[border:stop] change places, in place; the new border comes back."""
    for a, b in ((start, border), (border, stop), (start, stop)):
        buffer[a:b] = buffer[a:b][::-1]
    return start + stop - border


def transform(text: bytes, cut: Cut, recipe: Recipe) -> bytearray:
    """psm: `<P>`prefix`<S>`suffix`<M>`middle; spm: `<S>`suffix`<P>`prefix`<M>`middle; plain: the text."""
    buffer = bytearray(text)
    if cut.form == "plain":
        return buffer
    buffer[cut.second:cut.second] = recipe.suffix
    buffer[cut.first:cut.first] = recipe.middle
    buffer[0:0] = recipe.prefix
    middle = len(recipe.prefix) + cut.first
    suffix = middle + len(recipe.middle) + cut.second - cut.first
    border = rotate(buffer, middle, suffix, len(buffer))
    if cut.form == "spm":
        rotate(buffer, 0, middle, border)
    return buffer


def restore(output: bytes, form: str, recipe: Recipe) -> bytearray:
    """The text of which `output` was made in `form`: found sentinels tell the blocks, rotations bring them back."""
    buffer = bytearray(output)
    if form == "plain":
        return buffer
    if form not in FORMS:
        raise ValueError(f"no form {form!r}")
    middle = buffer.index(recipe.middle)
    if form == "spm":
        border = rotate(buffer, 0, buffer.index(recipe.prefix), middle)
    else:
        border = buffer.index(recipe.suffix)
    suffix = rotate(buffer, border, middle, len(buffer))
    for at, mark in ((suffix, recipe.suffix), (border, recipe.middle), (0, recipe.prefix)):
        if buffer[at:at + len(mark)] != mark:
            raise ValueError(f"not an output of form {form}")
        del buffer[at:at + len(mark)]
    return buffer


def _letters(text: bytes) -> int:
    return len(text) if text.isascii() else len(text.decode("utf-8", "replace"))


def fill_in_middle(docs: DataFrame, recipe: Recipe = Recipe(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row its id, `output`, `form`, `n` (lines), `prefix_chars` and `middle_chars` (code points; null if plain).

    One pass, no shuffle; a row's result depends on its id and text alone. Null and empty texts give an empty plain
    output of no lines; a text that contains a sentinel stays plain. A null id draws as an empty one. Rows repeated under
    one id are cut alike as far as their lines are. Other columns are not carried; an empty table gives no rows.
    """
    def work(batch):
        out = {k: [] for k in ("output", "form", "n", "prefix_chars", "middle_chars")}
        for doc_id, text in zip(batch.column("_id").to_pylist(), utf8(batch.column("_text"))):
            cut = plan(text, doc_id, recipe)
            moved = cut.form != "plain"
            out["output"].append(transform(text, cut, recipe).decode())
            out["form"].append(cut.form)
            out["n"].append(cut.units)
            out["prefix_chars"].append(_letters(text[:cut.first]) if moved else None)
            out["middle_chars"].append(_letters(text[cut.first:cut.second]) if moved else None)
        return out

    kind = docs.schema[id_col].dataType.simpleString()
    return per_batch(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), ["_id", "_text"],
                     f"_id {kind}, output string, form string, n long, prefix_chars long, middle_chars long", work).withColumnRenamed("_id", id_col)


def restored(made: DataFrame, recipe: Recipe = Recipe(), id_col: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of `made` its id and `text`, rebuilt from `output` and `form` alone; the columns in `carry` come along. A
    null output is an empty text."""
    def work(batch):
        forms = batch.column("form").to_pylist()
        return {"text": [restore(x, f, recipe).decode() for x, f in zip(utf8(batch.column("output")), forms)]}

    keep = [id_col, *carry]
    schema = ", ".join([*(f"`{c}` {made.schema[c].dataType.simpleString()}" for c in keep), "text string"])
    return per_batch(made, list(dict.fromkeys([*keep, "output", "form"])), schema, work, keep)


def digest(docs: DataFrame, recipe: Recipe = Recipe()) -> DataFrame:
    """Form, lengths and digests of the output and of the text restored from it."""
    made = fill_in_middle(docs, recipe).withColumn("output_sha256", F.sha2(F.col("output").cast("binary"), 256))
    back = restored(made, recipe, carry=("n", "form", "prefix_chars", "middle_chars", "output_sha256"))
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.sha2(F.col("text").cast("binary"), 256).alias("restored_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS lines,
       sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
n AS (SELECT *, len(lines) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
       CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
            WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT *, array_to_string(lines[1:low], '') AS prefix, array_to_string(lines[low + 1:high], '') AS middle, array_to_string(lines[high + 1:], '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""
