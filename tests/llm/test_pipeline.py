"""The pipeline against the operators' plain versions, one after the other."""

import random
import zlib
from collections import Counter

import corpus_pipeline
from tests.llm.test_operators import DOCS, TOXIC, jaccard, lang_rows, plain_contamination
from wayfare.llm import language, neardup, packing, toxicity


def test_run_equals_plain_stages(spark, tmp_path):
    r = random.Random(9)
    base = lang_rows(260, 11)
    rows, labels = [], []
    for i, t, lang in base:
        words, toxic = t.split(), int(r.random() < 0.15)
        if toxic:
            for _ in range(max(3, len(words) // 20)):
                words.insert(r.randrange(len(words)), r.choice(TOXIC))
        rows.append((i, " ".join(words), lang, "s", 0))
        labels.append((i, 1, toxic))
    items = [(1, " ".join(f"q{k}" for k in range(40)))]
    rows += [(300 + i, rows[i][1] + ("" if i % 2 else "!"), "aa", "s", 0) for i in range(20)]
    rows += [(400, rows[0][1] + " " + items[0][1], "aa", "s", 0), (401, None, None, "s", 0), (402, "1 2 3", "bb", "s", 0), (403, "", "bb", "s", 0)]
    d = str(tmp_path)
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")

    free = lambda i: zlib.crc32(str(i).encode()) % 4 != 2
    text = {i: t or "" for i, t, *_ in rows}
    index = toxicity.build(sorted((i, text[i], y) for i, _, y in labels if free(i)))
    kept = [x for x in rows if index.scores([text[x[0]]])[0][0] < 0.3]
    model = language.train(sorted((x[0], x[1], x[2]) for x in kept if x[1] is not None and x[2] and free(x[0])))
    kept = [x for x, (lang, s) in zip(kept, model.predict([text[x[0]] for x in kept]), strict=True) if lang != "und" and s >= 0.35]
    kmers = {x[0]: neardup.labelled_kmers(text[x[0]]) for x in kept}
    ids, parent = sorted(kmers), {i: i for i in kmers}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (text[a] == text[b] or jaccard(kmers[a], kmers[b]) >= 0.8):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    kept = [x for x in kept if find(x[0]) == x[0]]
    bad = {x[0] for x in plain_contamination([(x[0], x[1]) for x in kept], items) if x[5]}
    kept = [x for x in kept if x[0] not in bad]
    assert 400 not in {x[0] for x in kept} and 150 < len(kept) < 260
    encode = packing._encoder("byte_bpe_50k")
    want = Counter((x[0], len(encode(text[x[0]])) + 1) for x in kept)

    out = corpus_pipeline.run(spark, d).collect()
    assert Counter((x.doc_id, x.doc_tokens) for x in out if x.start == 0) == want
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == [c.split(" ")[0] for c in DOCS.split(", ")]
    assert {x.doc_id for x in docs.select("doc_id").collect()} == {x[0] for x in kept}


def test_run_over_empty_odd_and_clashing_tables(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = [(None, None, None, None, None), (None, "some words without an id here", "aa", "s", 1), (1, "", "aa", "s", 0), (2, "one two three four five six seven", "aa", "s", 0), (2, "a quite other text under the same id", "bb", "s", 0), (3, "one two three four five six seven", "aa", "s", 0)]
    for name, some in (("empty", []), ("odd", rows)):
        d = str(tmp_path / name)
        clash = spark.createDataFrame(some, DOCS).withColumns({c: F.lit("x") for c in ("key", "bad_id", "bad_key", "node", "own", "class_id", "label", "score", "rep", "words")})
        clash.write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(2, 1, 0), (2, 1, None), (None, None, 1)] if some else [], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(None, "x"), (1, None)] if some else [], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        out = corpus_pipeline.run(spark, d).collect()
        assert (len(out) >= 2) == bool(some) and all(x.length > 0 for x in out)
        if some:
            assert sorted(x.doc_id or 0 for x in out) == [0, 2, 2]  # texts go by what they say, whatever their ids


def test_models_are_trained_in_tasks(spark, monkeypatch):
    """Neither texts nor training stand in the driver, and workers get the model that training the same rows there would give."""
    import pickle

    rows = lang_rows(120, 5)
    docs = spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], DOCS)
    labels = spark.createDataFrame([(i, 1, i % 5 == 0 and 1 or 0) for i, *_ in rows], "doc_id long, quality int, toxic int")
    free = sorted(r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2)
    index, model = toxicity.build([(i, t, int(i % 5 == 0)) for i, t, _ in free]), language.train(free)

    def refuse(*_):
        raise AssertionError("trained in the driver")

    for module, name in ((toxicity, "_indexed"), (language, "_pairs")):
        monkeypatch.setattr(module, name, refuse)
    found, tagger = toxicity.fit(docs, labels), language.fit(docs)
    texts = [t for _, t, _ in rows]
    assert pickle.loads(pickle.dumps(found)).scores(texts) == index.scores(texts) and pickle.loads(pickle.dumps(tagger)).predict(texts) == model.predict(texts)
    assert type(pickle.loads(pickle.dumps(found))) is toxicity.Index and type(pickle.loads(pickle.dumps(tagger))) is language.Model
