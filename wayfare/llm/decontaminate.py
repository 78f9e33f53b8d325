"""Benchmark decontamination by winnowing, in DataFrame functions alone.

Every text is cut into words; each k consecutive words are hashed, and of every `span - k + 1` consecutive hashes the
smallest is kept. Two texts that share `span` words therefore share a kept fingerprint. Fingerprints of documents and
of benchmark items are joined; each hit fixes a diagonal (document position less item position), along which words are
compared and every run of at least `span` equal words is marked. Items shorter than `span` count as one window and are
looked up whole, by the hash of all their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import ascii_lower, persisted, spare

#: Words in a window that must match, and words in a fingerprint.
SPAN, GRAM = 13, 5
#: Up to so many fingerprints of items are looked up in a set that every task has; more are joined by shuffle.
SMALL_FINGERPRINTS = 20_000
#: Places of fingerprints, one row for each in each item, that are sent to all tasks at most; more are joined by a shuffle.
SMALL_PLACES = 100_000
#: Items are sent to all tasks whole if their words have at most so many bytes together.
SMALL_TEXTS = 8 << 20


def words_of(text: Column) -> Column:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased; null: none."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.array_remove(parts, "")


def _grams(words: Column, n: int) -> Column:
    """Hash of each n consecutive words, by position; empty if there are fewer."""
    at = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(n)]))


def _winnowed(grams: Column, window: int) -> Column:
    """Distinct minima of all windows of so many hashes (of all hashes, if there are fewer)."""
    last = F.greatest(F.size(grams) - window, F.lit(0))
    starts = F.when(F.size(grams) > 0, F.sequence(F.lit(1), last + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.array_min(F.slice(grams, i, window))))


def _runs(grams: Column, wanted: Column) -> Column:
    """Runs of one hash at consecutive positions, of hashes in wanted: print, first, last."""
    placed = lambda place: F.transform(grams, lambda h, i: F.struct(h.alias("print"), i.alias(place)))
    edge = lambda place, step: F.filter(placed(place), lambda r: F.array_contains(wanted, r["print"]) & ~F.coalesce(F.get(grams, r[place] + step) == r["print"], F.lit(False)))
    return F.zip_with(edge("first", -1), edge("last", 1), lambda a, b: F.struct(a["print"].alias("print"), a["first"].alias("first"), b["last"].alias("last")))


def _covered(same: Column, span: Column, first: Column) -> Column:
    """Positions, counted from first, of all runs of at least span true values."""
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(same) - span + 1, F.lit(1))), lambda i: (F.size(same) >= span) & ~F.array_contains(F.slice(same, i, span), False))
    return F.array_distinct(F.flatten(F.transform(starts, lambda i: F.sequence(first + i - 1, first + i + span - 2))))


def _row_key(doc_id: str, text: str) -> Column:
    """A hash of id and text: rows that have it in common get the same result."""
    return _pair_key(F.col(doc_id).cast("string"), F.coalesce(F.col(text), F.lit("")))


def _pair_key(a: Column, b: Column) -> Column:
    """A hash of two strings, the first of which may be null; its length stands before it, so that no two pairs read alike."""
    return F.md5(F.concat(F.coalesce(F.length(a).cast("string"), F.lit("null")), F.lit(":"), F.coalesce(a, F.lit("")), b).cast("binary"))


def decontaminate(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM, small: int = SMALL_FINGERPRINTS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies in any occurrence of a window of span consecutive words of an item (of all its words, if it
    has fewer); contaminated: at least one word and a twentieth of all are hit. Null or wordless texts and items have no
    windows: n_hit and n_items 0 and the digest of the empty string. Repeated rows each get their result. Items without an id are ignored; items that
    repeat an item_id count once. Empty tables give no rows or no hits. Other columns, of whatever name, are ignored.
    """
    return _judged(docs, items, span, gram, small, doc_id, text).drop("key")


def _judged(docs: DataFrame, items: DataFrame, span: int, gram: int, small: int, doc_id: str, text: str) -> DataFrame:
    """The rows of decontaminate() with the key of their row."""
    key = _row_key(doc_id, text)
    read = docs.select(F.col(doc_id).alias("doc_id"), key.alias("key"), words_of(F.col(text)).alias("words"))
    bench = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("item_words")).where(F.col("item_id").isNotNull() & (F.size("item_words") > 0)).withColumn("item_key", _pair_key(F.col("item_id"), F.array_join("item_words", " "))).dropDuplicates(["item_key"])

    # Fingerprints of the items: kind gram, or minus the number of words of a short item.
    long_items = bench.where(F.size("item_words") >= span).withColumn("grams", _grams(F.col("item_words"), gram)).withColumn("kept", _winnowed(F.col("grams"), span - gram + 1))
    prints = long_items.select("item_key", F.inline(_runs(F.col("grams"), F.col("kept")))).select("print", F.lit(gram).alias("kind"), "item_key", F.col("first").alias("item_first"), F.col("last").alias("item_last"))
    lengths = sorted(r[0] for r in bench.where(F.size("item_words") < span).select(F.size("item_words")).distinct().collect())  # at most span - 1
    for n in lengths:
        prints = prints.unionByName(bench.where(F.size("item_words") == n).select(F.element_at(_grams(F.col("item_words"), n), 1).alias("print"), F.lit(-n).alias("kind"), "item_key", F.lit(0).alias("item_first"), F.lit(0).alias("item_last")))
    counted = prints.groupBy("print", "kind").agg(F.count("*").alias("n")).limit(small + 1).collect()
    found, few = [(r["print"], r["kind"]) for r in counted], len(counted) <= small
    few_places = few and sum(r["n"] for r in counted) <= SMALL_PLACES

    kinds = {gram: (gram, span - gram + 1)} | {-n: (n, 1) for n in lengths}
    hashed = read.select("doc_id", "key", "words", *[_grams(F.col("words"), n).alias(f"grams{kind}") for kind, (n, _) in kinds.items()])
    kept = hashed.select("*", *[_winnowed(F.col(f"grams{kind}"), window).alias(f"kept{kind}") for kind, (_, window) in kinds.items()])
    if few:
        def known(kind: int) -> Column:
            own = [p for p, k in found if k == kind]
            return F.filter(F.col(f"kept{kind}"), lambda h: h.isin(own)) if own else F.array().cast("array<bigint>")

        sought = kept.select("doc_id", "key", "words", *[f"grams{kind}" for kind in kinds], *[known(kind).alias(f"known{kind}") for kind in kinds])
    else:
        def tagged(kind: int) -> Column:
            return F.transform(F.col(f"kept{kind}"), lambda h: F.struct(F.lit(kind).alias("kind"), h.alias("print")))

        pairs = kept.select("key", F.explode_outer(F.concat(*[tagged(kind) for kind in kinds])).alias("p")).select("key", "p.kind", "p.print")
        by_doc = pairs.join(prints.select("print", "kind").distinct(), ["print", "kind"]).groupBy("key").agg(*[F.collect_set(F.when(F.col("kind") == kind, F.col("print"))).alias(f"known{kind}") for kind in kinds])
        nothing = F.array().cast("array<bigint>")
        sought = hashed.join(by_doc, "key", "left").withColumns({f"known{kind}": F.coalesce(f"known{kind}", nothing) for kind in kinds})

    def places(kind: int) -> Column:
        found = F.transform(_runs(F.col(f"grams{kind}"), F.col(f"known{kind}")), lambda r: F.struct(F.lit(kind).alias("kind"), r["print"].alias("print"), r["first"].alias("first"), r["last"].alias("last")))
        return F.when(F.size(f"known{kind}") > 0, found)

    none = F.array().cast("array<struct<kind:int,print:bigint,first:int,last:int>>")
    located = sought.select("doc_id", "key", "words", F.concat(*[F.coalesce(places(kind), none) for kind in kinds]).alias("hits"))
    # One pass over the texts; words stay only where there is a hit.
    scanned = persisted(located.select("doc_id", "key", F.size("words").alias("n_words"), F.when(F.size("hits") > 0, F.col("words")).alias("words"), F.when(F.size("hits") > 0, F.col("hits")).alias("hits")), "decontaminate")

    hits = scanned.where(F.col("hits").isNotNull()).select("key", F.inline("hits"))
    # A run of n equal hashes and one of m lie on n + m - 1 diagonals, not n x m.
    met = hits.join(F.broadcast(prints) if few_places else prints, ["print", "kind"])
    lines = met.select("key", "item_key", F.explode(F.sequence(F.col("first") - F.col("item_last"), F.col("last") - F.col("item_first"))).alias("shift")).distinct()
    texts = bench.select("item_key", "item_id", "item_words")
    n_bytes = bench.agg(F.sum(F.octet_length(F.array_join("item_words", " ")))).first()[0] or 0
    both = lines.join(F.broadcast(texts) if n_bytes <= SMALL_TEXTS else texts, "item_key").join(scanned.where(F.col("words").isNotNull()).select("key", "words").dropDuplicates(["key"]), "key")
    n_item, n_doc, shift = F.size("item_words"), F.size("words"), F.col("shift")
    first, last = F.greatest(F.lit(0), -shift), F.least(n_item, n_doc - shift) - 1
    same = F.transform(F.sequence(first, last), lambda j: F.coalesce(F.get(F.col("item_words"), j) == F.get(F.col("words"), j + shift), F.lit(False)))
    compared = both.select("key", "item_id", (first + shift).alias("from"), F.least(F.lit(span), n_item).alias("need"), same.alias("same"))
    marked = compared.select("key", "item_id", _covered(F.col("same"), F.col("need"), F.col("from")).alias("covered")).select("key", "item_id", F.explode_outer("covered").alias("at")).where(F.col("at").isNotNull())
    n_hit = marked.select("key", "at").distinct().groupBy("key").agg(F.count("*").alias("n_hit"))
    ids = marked.select("key", "item_id").distinct().groupBy("key").agg(F.count("*").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("item_id"))), 256).alias("items_sha256"))
    n_words, hit = F.col("n_words").cast("long"), F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    return scanned.select("doc_id", "key", "n_words").join(n_hit.join(ids, "key"), "key", "left").select("doc_id", "key", n_words.alias("n_words"), hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), ((hit > 0) & (20 * hit >= n_words)).alias("contaminated"))


def keep_uncontaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that are not contaminated, each row by its own text whatever its id."""
    bad_key = spare(docs, "bad_key")
    bad = _judged(docs, items, SPAN, GRAM, SMALL_FINGERPRINTS, doc_id, text).where("contaminated").select(F.col("key").alias(bad_key)).distinct()
    return docs.join(bad, _row_key(doc_id, text) == F.col(bad_key), "left_anti")
