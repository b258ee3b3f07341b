"""The pipeline's stages on a small corpus with planted cases, held against brute force."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from icupanel.llm import copies
from icupanel.llm.common import bucket_components
from tests.llm.test_operators import DOCS, components, prose, slow_fingerprint


def test_pipeline(spark, tmp_path):
    rng = random.Random(21)
    bench = [(i, prose(rng, 30, 5000)) for i in range(3)]
    rows = []
    for i in range(120):
        kind = i % 6
        text = prose(rng, 80, 3000) + "."
        if kind == 5:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if kind == 4 and i > 6:
            text = rows[0][1]
        if kind == 3 and i < 20:
            text += " " + bench[i % 3][1]
        rows.append((i, text, "en", "a" if i % 3 else "b", len(text)))
    folder = str(tmp_path)
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 != 5), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    left = {i for i, *_ in rows if i % 6 != 5}
    one = corpus_pipeline.keep_quality(spark, docs, folder)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == left
    fps = {i: slow_fingerprint(t) for i, t, *_ in rows if i in left}
    classes = components(sorted(set(fps.values())), lambda a, b: (a ^ b).bit_count() <= 2)
    firsts = {}
    for i in sorted(left):
        firsts.setdefault(classes[fps[i]], i)
    two = corpus_pipeline.drop_near_copies(spark, one, folder)
    assert {r.doc_id for r in two.collect()} == set(firsts.values())
    three = corpus_pipeline.drop_benchmark(spark, two, folder)
    kept = {i for i in firsts.values() if not any(t in rows[i][1] for _, t in bench)}
    assert {r.doc_id for r in three.collect()} == kept and three.columns == docs.columns
    four = corpus_pipeline.mix_sources(spark, three, folder)
    assert four.columns == docs.columns and {r.doc_id for r in four.collect()} <= kept
    out = corpus_pipeline.run(spark, folder)
    assert Counter(r.doc_id for r in four.collect()) == Counter(r.doc_id for r in out.collect())
    slots = out.groupBy("shard").agg(F.max("slot").alias("top"), F.count("*").alias("n"), F.countDistinct("slot").alias("d")).collect()
    assert all(r.top == r.n - 1 == r.d - 1 for r in slots)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality classifier", "simhash near-dedup", "benchmark decontamination", "source mixing", "sharding"]


def test_near_copies_of_edited_texts(spark):
    """Edited copies from similarity 0.8 up leave one row a component, as by brute force."""
    rng = random.Random(31)
    rows = []
    for size in (6, 30, 100, 300, 900):
        for _ in range(8):
            words = prose(rng, size, 4000).split()
            for share in (0, 0, 0.003, 0.01, 0.02, 0.03, 0.06):
                edited = [f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in words]
                rows.append((len(rows), " ".join(edited), "en", "a", 0))
    rows += [(None, rows[3][1], "en", "a", 0), (5, rows[5][1], "en", "a", 0), (None, "a text of its own", "en", "a", 0), (9000, None, "en", "a", 0), (9001, " ", "en", "a", 0)]
    sets = [frozenset(zip(*[w[j:] for j in range(max(1, min(5, len(w))))])) for w in ((t or "").split() for _, t, *_ in rows)]

    def near(i, j):
        both = len(sets[i] & sets[j])
        return both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9

    classes = components(list(range(len(rows))), near)
    ids = {}
    for i, k in classes.items():
        ids.setdefault(k, []).append(rows[i][0])
    want = Counter(min((x for x in v if x is not None), default=None) for v in ids.values())
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, DOCS), "")
    assert Counter(r.doc_id for r in kept.collect()) == want and kept.columns == list(spark.createDataFrame([], DOCS).columns)


def test_histogram_bound_loses_nothing():
    """Sets of similarity 0.8 or more always pass; most unlike ones don't."""
    rng = np.random.default_rng(0)
    for n in (1, 5, 40, 300, 5000):
        passed = unlike = 0
        for _ in range(60):
            base = np.unique(rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64) * np.uint64(2))
            share = 0.5 + rng.random() / 2
            a, b = (base[rng.random(len(base)) < share] for _ in range(2))
            likeness = len(np.intersect1d(a, b)) / max(1, len(np.union1d(a, b)))
            may = copies.may_be_similar(copies.histogram(a), copies.histogram(b), 0.8)
            assert may or likeness < 0.8
            unlike += likeness < 0.5
            passed += likeness < 0.5 and may
        assert n < 40 or passed <= 0.1 * unlike
    assert copies.may_be_similar(b"", copies.histogram(base), 0.8)


def test_late_meetings_are_not_verified(spark):
    """Sets whose first common element comes too late in both are no pair; those that meet early are."""
    seen = []

    def verify(pairs):
        seen.extend((r.a, r.b) for r in pairs.collect())
        return pairs

    late, early = [(i, 10, 7, 2) for i in range(40)], [(i, 10, 8, 1) for i in (50, 51)]
    met = spark.createDataFrame(late + early, "id long, n int, key long, at int")
    labels = bucket_components(met, verify, 0.8)
    assert set(seen) == {(50, 51)} and {tuple(r) for r in labels.collect()} == {(50, 50), (51, 50)}


def test_simhash_links_come_first(spark, monkeypatch):
    """Near copies are linked by SimHash fingerprints; without the prefix filter those within the radius are still one row."""
    rng = random.Random(41)
    base = prose(rng, 400, 4000).split()
    texts = [" ".join(base[:k] + [f"e{k}"] + base[k + 1 :]) for k in range(0, 400, 40)] + [prose(rng, 60, 4000) for _ in range(5)]
    fps = [slow_fingerprint(t) for t in texts]
    classes = components(list(range(len(texts))), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    assert len(set(classes.values())) < len(texts)
    monkeypatch.setattr(copies, "bucket_components", lambda met, *a, **k: bucket_components(met.where("false"), *a, **k))
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], DOCS), "")
    assert {r.doc_id for r in kept.collect()} == set(classes.values())


def test_edited_copies_meet_in_few_pairs(spark, monkeypatch):
    """A group of edited copies, half of them too far from all others, is gone through in few pairs a text, not all of them."""
    rng = random.Random(43)
    base = prose(rng, 150, 4000).split()
    texts = [" ".join(base)]
    for i in range(400):
        w = list(base)
        for k in rng.sample(range(150), 2 + i % 8):
            w[k] = f"e{rng.randrange(10**9)}"
        texts.append(" ".join(w))
    seen = []

    def counted(met, verify, *a, **k):
        def watch(pairs):
            seen.append(pairs.count())
            return verify(pairs)
        return bucket_components(met, watch, *a, **k)

    monkeypatch.setattr(copies, "bucket_components", counted)
    corpus_pipeline.drop_near_copies(spark, spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], DOCS), "").count()
    assert sum(seen) <= 10 * len(texts), seen
