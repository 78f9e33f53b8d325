"""Quality scores, dominance counts and fill-in-the-middle, against plain versions and on odd input."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from wayfare.llm import dominance, fim, quality
from wayfare.llm.common import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(None, "one two three four five six"), (1, None), (2, ""), (3, "   \n"), (4, "12 345 --"), (5, "same text here"), (5, "same text here"), (6, "same text here"), (7, "á \U0001f600\x00é\r\n" * 3), (8, "long words " * 100_000), (9, "<S> inside"), (-3, "<<P>S<")]


def docs(spark, rows):
    df = spark.createDataFrame([(i, t, None, "s", 0) for i, t in rows], DOCS)
    return df.withColumns({c: F.lit("x") for c in ("n", "form", "output", "r", "stats", "fold", "y", "score", "label")})


# op11
def test_isotonic_against_plain():
    r = random.Random(3)
    for _ in range(50):
        count = np.array([r.randrange(1, 5) for _ in range(12)], dtype=float)
        good = np.array([r.randrange(0, int(c) + 1) for c in count], dtype=float)
        got = quality.isotonic(count, good)
        # min-max formula of isotonic regression
        mean = lambda i, j: good[i : j + 1].sum() / count[i : j + 1].sum()
        want = [max(min(mean(i, j) for j in range(k, 12)) for i in range(k + 1)) for k in range(12)]
        assert np.allclose(got, want)


def test_features_approximate_the_gaussian_kernel():
    r = np.random.default_rng(5)
    d = len(quality.STATISTICS)
    x = r.normal(size=(200, d))
    z = quality.Features(np.zeros(d), np.ones(d))(x)[:, :-1]
    square = ((x[:, None] - x[None]) ** 2).sum(-1)
    want = np.exp(-square / (2 * quality.WIDTH**2 * d))
    assert np.abs(z @ z.T - want).mean() < 0.06


def test_quality_sums_equal_the_undivided_equations_and_the_held_out_fold_is_right(spark):
    d = "/root/testdata/sf0.01"
    stats = quality.measured(table(spark, d, "documents"))
    labels = table(spark, d, "labels")
    model = quality.fit(stats, labels)
    y = {r.doc_id: min(r.quality, 1) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    rows = [r for r in stats.collect() if r.doc_id in y]
    x = np.array([r.stats for r in rows])
    assert np.allclose(model.features.mean, x.mean(0)) and np.allclose(model.features.scale, np.where(x.std(0) > 1e-9, x.std(0), 1))
    z, t = model.features(x), np.array([y[r.doc_id] for r in rows])
    plain = np.linalg.solve(z.T @ z + model.ridge * len(z) * np.diag([1.0] * quality.FEATURES + [1e-6]), z.T @ t)
    assert np.allclose(z @ plain, z @ model.weights, atol=1e-6)
    assert (np.diff(model.share) >= 0).all()
    got = quality.score(stats, model).join(labels.select("doc_id", "quality"), "doc_id").where("held_out").collect()
    assert len(got) > 100 and sum(r.predicted == r.quality for r in got) >= 0.98 * len(got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_quality_edges(spark):
    labels = spark.createDataFrame([(3, 0, 0), (3, 1, 0), (5, 1, 0), (None, 1, 0), (6, None, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    stats = quality.measured(docs(spark, ODD))
    model = quality.fit(stats, labels)
    got = quality.score(stats, model).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in ODD)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert len({r.score for r in got if r.doc_id in (5, 6)}) == 1 and len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    none = quality.fit(stats, labels.limit(0))
    assert {r.score for r in quality.score(stats, none).collect()} == {0.0}
    empty = quality.measured(docs(spark, ODD).limit(0))
    assert quality.score(empty, quality.fit(empty, labels)).count() == 0


# op12
@pytest.mark.parametrize(("part", "levels", "slots", "n"), [(1 << 15, 50, 40, 500), (7, 30_000, 40, 1200), (20, 1 << 40, 1000, 1200), (50, 100, 3, 3000)])
def test_dominance_against_brute_force(spark, monkeypatch, part, levels, slots, n):
    monkeypatch.setattr(dominance, "PART", part)
    r = random.Random(1)
    some = lambda k: r.randrange(-k, k) if r.random() > 0.02 else None
    points = [(some(slots), some(levels), r.choice((1, 2))) for _ in range(n)]
    got = {(x.slot, x.level): (x.n, x.w) for x in dominance.counts(spark.createDataFrame(points, "slot long, level long, weight long")).collect()}
    whole = np.array([p for p in points if None not in p])
    for slot, level, _ in whole.tolist():
        above = (whole[:, 0] <= slot) & (whole[:, 1] > level)
        assert got[slot, level] == (above.sum(), whole[above, 2].sum())
    assert len(got) == len({(s, v) for s, v, _ in whole.tolist()})


def test_dominance_of_one_hot_pair_and_slots_over_batches(spark, monkeypatch):
    monkeypatch.setattr(dominance, "PART", 100)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        points = [(5, 3, 1)] * 3000 + [(s, v, 2) for s in range(10) for v in range(40)]
        got = {(x.slot, x.level): (x.n, x.w) for x in dominance.counts(spark.createDataFrame(points, "slot long, level long, weight long")).collect()}
        for s in range(10):
            for v in range(40):
                n = (s + 1) * (39 - v)
                hot = 3000 if s >= 5 and v < 3 else 0
                assert got[s, v] == (n + hot, 2 * n + hot)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_sales_edges(spark):
    rows = [(1, 10.0, "2024-01-01 05:30:00"), (2, 12.0, "2024-01-01 05:59:59.999999"), (2, 12.0, "2024-01-01 05:59:59.999999"), (3, None, "2024-01-01 00:00:00"), (4, 99.0, None), (None, 10.999, "2024-01-01 04:00:00"), (6, float("nan"), "2024-01-01 00:00:00"), (7, -0.5, "1969-12-31 23:59:59"), (8, 9.999, "2024-01-01 07:00:00")]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", z)
            df = spark.createDataFrame(rows, "sale_id long, total double, at string").select("sale_id", "total", F.col("at").cast("timestamp_ntz").alias("sold_at"), F.lit(1).alias("slot"), F.lit(2).alias("level"), F.lit(3).alias("weight"), F.lit(4).alias("n"))
            got = {(r.sale_id, r.slot, r.level, r.n_sales, r.n_rows) for r in dominance.sales_above(df).collect()}
            hour = 19723 * 24
            w = {i: 1 + zlib.crc32(str(i).encode()) % 2 for i in (1, 2, 8)}
            assert got == {(1, hour + 5, 10, 3, 2 * w[2] + 1), (2, hour + 5, 12, 0, 0), (3, hour, None, None, None), (4, None, 99, None, None), (None, hour + 4, 11, 0, 0), (6, hour, None, None, None), (7, -1, -1, 0, 0), (8, hour + 7, 10, 3, 2 * w[2] + 1)}
            assert dominance.sales_above(df.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


# op13
def plain(doc_id, text):
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_fim_against_plain_and_restored(spark):
    r = random.Random(2)
    rows = ODD + [(i, "".join(r.choice("ab<>PSM \ńé\U0001f600") for _ in range(r.randrange(0, 40)))) for i in range(100, 400)]
    key = lambda x: (x[0] is None, x[0], x[-1])
    got = sorted(((x.doc_id, x.n, x.form, x.prefix_chars, x.middle_chars, x.output, x.output_sha256, x.restored_sha256) for x in fim.transform(docs(spark, rows)).collect()), key=key)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted(((i, *p, digest(p[-1]), digest(t or "")) for i, t in rows for p in [plain(i, t or "")]), key=key)
    assert got == want
    assert {x[2] for x in got} == {"plain", "spm", "psm"}
    assert fim.transform(docs(spark, ODD).limit(0)).count() == 0
    assert "output" not in fim.transform(docs(spark, ODD), outputs=False).columns


def test_fim_of_other_units():
    word = regex.compile(r"\S+\s*")
    for i in range(200):
        n, form, a, m, out = fim.rewrite("  one two  three\nfour five", i, word)
        assert n == 5 and fim.restore(out, form) == "  one two  three\nfour five"
        assert form == "plain" or all(k in (0, 6, 11, 17, 22, 26) for k in (a, a + m))


# op2: examples
def test_only_near_copies_of_the_same_label_go():
    from wayfare.llm.toxicity import distinct

    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    texts = [[word() for _ in range(120)] for _ in range(300)]
    near = lambda w, k: [word() if i == k else x for i, x in enumerate(w)]
    rows = [(("own", i), w, i % 2) for i, w in enumerate(texts)]
    rows += [(("copy", i), near(w, 60), i % 2) for i, w in enumerate(texts)] + [(("other label", i), near(w, 30), 1 - i % 2) for i, w in enumerate(texts[:100])]
    rows += [(("half", i), w[:70] + [word() for _ in range(50)], i % 2) for i, w in enumerate(texts[:100])]
    stayed = {k for k, *_ in distinct(rows)}
    shingles = lambda w: {" ".join(w[i : i + 4]) for i in range(len(w) - 3)}
    text, label = {k: w for k, w, _ in rows}, {k: y for k, _, y in rows}
    assert {k for k in label if k[0] != "copy"} <= stayed
    gone = [k for k in label if k not in stayed]
    assert len(gone) > 250
    for _, i in gone:
        a, b = shingles(text["copy", i]), shingles(text["own", i])
        assert len(a & b) >= 0.8 * len(a | b) and label["copy", i] == label["own", i]


# op10: an item passage that many items share, with what is broadcast and without
@pytest.mark.parametrize(("places", "texts"), [(100_000, 8 << 20), (10, 10)])
def test_decontamination_by_shuffles_gives_the_same(spark, monkeypatch, places, texts):
    from wayfare.llm import decontaminate

    monkeypatch.setattr(decontaminate, "SMALL_PLACES", places)
    monkeypatch.setattr(decontaminate, "SMALL_TEXTS", texts)
    passage = " ".join(f"p{i}" for i in range(30))
    items = spark.createDataFrame([(i, f"{passage} own{i}") for i in range(60)], "item_id long, text string")
    rows = [(1, f"before {passage} after"), (2, "nothing of the kind " * 10), (3, f"x{' x' * 700} {passage}"), (4, None)]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.decontaminate(docs(spark, rows), items).collect()}
    assert got == {1: (32, 30, 60, True), 2: (40, 0, 0, False), 3: (731, 30, 60, False), 4: (0, 0, 0, False)}
