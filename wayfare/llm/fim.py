"""Fill-in-the-middle: texts cut into prefix, middle and suffix at hashed places and put together in another order.

One Arrow-batched pandas UDF and no shuffle. A pattern's matches (finditer of the regex library) are the units of a text,
code points unless told otherwise; their end offsets are collected in a compact array, two look-ups in it give the cuts, and
hashlib gives the seeds and the digests. What a document becomes is decided by its id and its own text alone.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import in_small_batches, release

#: Marks before a prefix, a suffix and a middle; a text that holds one of them stays plain.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents, those that are cut; of 100 of these, those whose suffix comes first.
CUT_OF_100, SUFFIX_FIRST_OF_100 = 90, 20
#: A unit is one code point, line ends too.
CODE_POINT = r"(?s:.)"

_ROW = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"


def draws(doc_id: int | None, seed: int = 1) -> tuple[int, int, int, int]:
    """The first four 32-bit numbers of sha256('seed:doc_id'); a null id has no digits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))


def unit_ends(text: str, unit: regex.Pattern) -> array:
    """End offset, in code points, of each unit of text."""
    return array("L", [0]) + array("L", (m.end() for m in unit.finditer(text)))


def rewrite(text: str, doc_id: int | None, unit: regex.Pattern, seed: int = 1) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix and of the middle or None, output)."""
    ends = unit_ends(text, unit)
    n = len(ends) - 1
    first, second, share, order = draws(doc_id, seed)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or share % 100 >= CUT_OF_100:
        return n, "plain", None, None, text
    a, b = sorted((first % (n + 1), second % (n + 1)))
    # What follows the last unit belongs to the suffix, what stands between units to the unit that follows.
    a, b = ends[a], ends[b]
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if order % 100 < SUFFIX_FIRST_OF_100:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text that an output of rewrite() was made of. The parts hold no mark, and no mark begins as another one ends, so
    that the first place of a mark is the mark that was put there."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, _, rest = output.removeprefix(first).partition(second)
    other, _, middle = rest.partition(MIDDLE)
    return one + middle + other if form == "psm" else other + middle + one


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: str = CODE_POINT, seed: int = 1, outputs: bool = True) -> DataFrame:
    """One row per document: doc_id, n (units), form (plain, psm or spm), prefix_chars and middle_chars (code points; null if
    plain), output (the rewritten text, unless outputs is False), and the SHA-256 of the output and of the text restored from it.

    A null text is empty; an empty text is plain, with n 0. A null id draws as an id without digits; rows of one id and text
    are rewritten alike, each on its own. An empty table gives no rows; other columns, whatever their names, are no input.
    Whole texts are read, one at a time, with one offset of 8 bytes a unit.
    """
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()

    @F.pandas_udf(_ROW)
    def rewritten(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        pattern = regex.compile(unit)
        columns = [c.split(" ")[0] for c in _ROW.split(", ")]
        release()
        for ids, texts in batches:
            rows = []
            for i, t in zip(ids, texts, strict=True):
                n, form, prefix, middle, output = rewrite(t or "", int(i) if i else None, pattern, seed)
                rows.append((n, form, prefix, middle, output if outputs else None, digest(output), digest(restore(output, form))))
            out = pd.DataFrame(rows, columns=columns)
            yield out.astype({c: "Int64" for c in ("n", "prefix_chars", "middle_chars")})

    # An id goes as text: a null among numbers would make them doubles.
    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = in_small_batches(read).select("doc_id", rewritten(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))).alias("r")).select("doc_id", "r.*")
    return out if outputs else out.drop("output")
