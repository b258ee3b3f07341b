"""Clashing column names, repeated rows, bounds and crowds."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from icupanel.llm import copies, decontaminate, licenses, lines, mixing, quality, sharding, simhash
from tests.llm.test_operators import DOCS, documents, prose

#: All names that the operators give columns of their own.
INTERNAL = (
    "_id _hash _mark _turn _text _gone _bucket _draws _cdf _u _other _top _passed _own _block _base _h _n row id hash mark gone gone_id gone_text found_id found_hash key other bucket h no part at turn top passed own block base "
    "n_a n_b node component first hot hot_doc hot_text hot_no line_id best c g great kept text_id line_no fp").split()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), DOCS)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, documents()[62][1]), (2, documents()[5][1])], "item_id long, text string")


def operators(bench):
    return {
        "decontaminate": lambda d: decontaminate.decontaminate(d, bench), "dedup_lines": lines.dedup_lines, "copies": copies.keep_one_per_group, "simhash": simhash.keep_one_per_group,
        "mixing": mixing.poisson_mix, "sharding": lambda d: sharding.shard(d, 4), "quality": lambda d: quality.scored(d, quality.Model())}


@pytest.mark.parametrize("name", ["decontaminate", "dedup_lines", "copies", "simhash", "mixing", "sharding", "quality"])
def test_internal_names(spark, docs, bench, name):
    """Extra columns under internal names change no result, and come out as they were."""
    run = operators(bench)[name]
    crowded = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in INTERNAL})
    plain, got = run(docs), run(crowded)
    key = [c for c in ("doc_id", "text", "shard", "n_copies", "copy_no", "score") if c in plain.columns]
    assert Counter(map(tuple, got.select(*key).collect())) == Counter(map(tuple, plain.select(*key).collect()))
    assert set(crowded.columns) <= set(got.columns)
    wrong = [~F.col(n).eqNullSafe(F.concat(F.lit(n), F.col("doc_id").cast("string"))) for n in INTERNAL]
    assert got.where(F.array_contains(F.array(*wrong), True)).count() == 0


@pytest.mark.parametrize("name", ["decontaminate", "dedup_lines", "copies", "simhash", "mixing", "sharding", "quality"])
def test_no_rows(spark, bench, name):
    got = operators(bench)[name](spark.createDataFrame([], DOCS))
    assert got.count() == 0 and {"doc_id", "text"} <= set(got.columns)


def test_stages_keep_clashing_columns(spark, docs, tmp_path):
    spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, documents()[62][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    crowded = docs.withColumns({n: F.lit(n) for n in INTERNAL})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, got = stage(spark, docs, str(tmp_path)), stage(spark, crowded, str(tmp_path))
        assert got.columns == crowded.columns, name
        assert Counter(r.doc_id for r in got.collect()) == Counter(r.doc_id for r in plain.collect()), name


@pytest.mark.parametrize("shards", [5, 40])
def test_repeated_rows_are_dealt_by_count(spark, shards):
    """Half and more of the rows equal: shards stay even in bytes, slots gapless."""
    rng = random.Random(3)
    rows = [(None, "", "en", "s", 0)] * 400 + [(7, "same text", "en", "s", 9)] * 300 + [(i, prose(rng, rng.randrange(20)), "en", "s", 0) for i in range(100)]
    got = sharding.shard(spark.createDataFrame(rows, DOCS).repartition(7), shards, blocks=2).collect()
    size, slots = Counter(), {}
    for r in got:
        size[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r.slot)
    mean, longest = sum(size.values()) / shards, max(r["size"] for r in got)
    assert len(got) == 800 and set(size) == set(range(shards)) and all(abs(n - mean) <= longest for n in size.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    order = sorted(got, key=lambda r: (r["shard"], r.slot))
    keys = [(r.text, r.doc_id) for r in order]
    assert sum(a != b for a, b in zip(keys, keys[1:])) == len(set(keys)) - 1  # equal rows are neighbours


def test_fit_rows_bounds_what_the_driver_gets(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append(len(x)) or quality.Model())
    rows = [(2, f"text {i}") for i in range(500)] + [(i, f"other {i}") for i in range(1000, 1100)]
    labels = [(2, 1), *((i, i % 2) for i in range(1000, 1100))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (10, 10_000):
        quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"), fit_rows=most)
        assert seen[-1] <= min(2 * most, 101)


def test_blank_lines_of_any_white_space_stay(spark):
    text = "a first line of some length here\r\n\r\n\t\r\nanother line, quite unlike it\r\n\r\n \x0b \n\t\n"
    got = lines.dedup_lines(spark.createDataFrame([(1, text), (2, text + "a first line of some length here\r")], "doc_id long, text string")).collect()
    kept = {r.doc_id: r.text for r in got}
    assert kept[1] == text and kept[2] == "\r\n\t\r\n\r\n \x0b \n\t"


@pytest.mark.parametrize("exact", [False, True])
def test_pairs_in_a_crowd_are_found(spark, exact):
    """Pairs of similarity 0.8 and more among hundreds of lines that share half of each with them."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    shared = " ".join(word() for _ in range(30))
    texts, pairs = [f"{shared} {' '.join(word() for _ in range(30))}" for _ in range(200)], []
    for k in range(60):
        own = [word() for _ in range(30)]
        pairs.append((len(texts), len(texts) + 1))
        texts += [f"{shared} {' '.join(own)}", f"{shared} {' '.join([*own[:-2], word(), own[-1]])}"]
    got = {r.doc_id: r.component_id for r in lines.near_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), exact=exact).collect()}
    grams = [{t.encode()[i : i + 5] for i in range(len(t) - 4)} for t in texts]
    near = [(a, b) for a, b in pairs if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])]
    assert len(near) > 50
    assert sum(got[a] == got[b] for a, b in near) >= (1.0 if exact else 0.95) * len(near)
    groups = {}
    for i, c in got.items():
        groups.setdefault(c, []).append(i)
    for own in groups.values():  # no component without a link
        assert len(own) == 1 or all(any(len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]) for b in own if b != a) for a in own)


def test_unlike_lines_of_a_crowd_are_not_fetched(spark, monkeypatch):
    """Of hundreds of lines with a common passage and common words only those that may be similar are verified on their texts."""
    rng, tried, found = random.Random(9), [], lines.links
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    words = [word() for _ in range(300)]
    shared = " ".join(rng.sample(words, 12))
    texts = [f"{shared} {' '.join(rng.choices(words, k=60))}" for _ in range(300)]
    texts += [f"{t} end" for t in texts[:20]]

    def watch(texts, pairs, similarity):
        tried.append(pairs.count())
        return found(texts, pairs, similarity)

    monkeypatch.setattr(lines, "links", watch)
    got = {r.doc_id: r.component_id for r in lines.near_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(got[k] == got[300 + k] for k in range(20)) and len(set(got.values())) == 300
    assert sum(tried) <= 40


@pytest.mark.parametrize("size", [30, 200, 395, 440, 890, 980, 1990, 3000])
def test_sketches_rule_out_unlike_lines_only(spark, size):
    """Sketches let all similar lines by, on both sides of the sizes where sketches grow, and few unlike ones."""
    rng = random.Random(size)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows = []
    for _ in range(30):
        t = text(size)
        rows += [(t, t + text(max(1, size // 5))), (t, t[: size * 9 // 10] + text(size // 11)), (t, text(size))]
    known = spark.createDataFrame([(2 * k + side, t) for k, pair in enumerate(rows) for side, t in enumerate(pair)], "line_id long, line string")
    signs = lines.sketches(known.unionByName(known.limit(7)))  # repeated lines count once
    side = lambda c: signs.select((F.col("id") / 2).cast("int").alias("k"), F.col("id"), F.struct("*").alias(c)).where(F.col("id") % 2 == int(c == "b"))
    got = {r.k: r for r in side("a").drop("id").join(side("b").drop("id"), "k").select("k", "a.n", F.col("b.n").alias("m"), lines.may_be_similar("a.", "b.", 0.8).alias("may")).collect()}
    grams = lambda t: {t.encode()[i : i + 5] for i in range(max(1, len(t) - 4))}
    similar = {k: len(grams(a) & grams(b)) >= 0.8 * len(grams(a) | grams(b)) for k, (a, b) in enumerate(rows)}
    assert len(got) == len(rows) and sum(similar.values()) >= 30
    assert all((got[k].n, got[k].m) == (len(grams(a)), len(grams(b))) for k, (a, b) in enumerate(rows))
    assert all(got[k].may for k in got if similar[k])
    assert size > 2000 or sum(got[k].may for k in got if k % 3 == 2) == 0


# --- licenses -------------------------------------------------------------

def licenses_by_all_windows(text, tolerance=0.1):
    """Names of all templates that some window of words quotes within the tolerance."""
    own, found = licenses.words(text), set()
    for name, ts in licenses.TEMPLATES.items():
        for t in ts:
            template = licenses.words(t)
            slack = int(tolerance * len(template))
            for size in range(len(template) - slack, len(template) + slack + 1):
                for a in range(max(1, len(own) - size + 1)):
                    window = own[a : a + size]
                    if sum((Counter(template) & Counter(window)).values()) < len(template) - slack:
                        continue
                    missing, added = licenses.differences(template, window)
                    if len(missing) + len(added) <= tolerance * len(template) and not any(w[0].isdigit() for w in missing + added):
                        found.add(name)
    return found


def test_licenses_against_all_windows(spark):
    """Short and whole texts, edited within and beyond the tolerance, without cue words of any kind."""
    rng = random.Random(4)
    texts, exact = [], {}
    for name, ts in licenses.TEMPLATES.items():
        for t in ts:
            words = t.split()
            for share in (0.0, 0.05, 0.3):
                new = list(words)
                for k in rng.sample(range(len(new)), int(share * len(new))):
                    new[k] = "other"
                if not share:
                    exact[len(texts)] = name
                texts.append(f"{prose(rng, 30)}. {' '.join(new)} {prose(rng, 30)}.")
    texts += [prose(rng, 80), "the software is provided as is", "permission and license and copyright"]
    got = {}
    for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ranked=100).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    for i, t in enumerate(texts):
        # of licenses that one block quotes, as GPL and LGPL, only the nearest comes out
        every = licenses_by_all_windows(t)
        assert got.get(i, set()) <= every and bool(got.get(i)) == bool(every), t
        assert i not in exact or exact[i] in got[i]


def test_a_notice_without_its_usual_words(spark):
    text = licenses.TEMPLATES["MIT"][2].replace("Permission", "Authorization")
    rows = [(1, text), (2, licenses.FULL_TEXTS["MIT"]), (3, licenses.FULL_TEXTS["BSD-3-Clause"]), (5, "Copyright (c) 2020 A. Person\n\n" + licenses.FULL_TEXTS["ISC"])]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.license for r in got if len(r.template) > 200 or r.doc_id == 1} == {1: "MIT", 2: "MIT", 3: "BSD-3-Clause", 5: "ISC"}
    assert next(r for r in got if r.doc_id == 1).missing == ["permission"]


def test_no_pair_in_a_crowd_is_dropped(spark, monkeypatch):
    """Every pair just above similarity 0.8 in one crowded band is found without any switch."""
    rng = random.Random(12)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    texts = [t for own in (letters(152) for _ in range(400)) for t in (own + letters(18), own + letters(18))]
    monkeypatch.setattr(lines, "band_keys", lambda d: d.select("line_id", F.lit(1).cast("long").alias("key")))
    got = {r.doc_id: r.component_id for r in lines.near_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    grams = [{t.encode()[i : i + 5] for i in range(len(t) - 4)} for t in texts]
    near = [k for k in range(0, len(texts), 2) if len(grams[k] & grams[k + 1]) >= 0.8 * len(grams[k] | grams[k + 1])]
    assert len(near) > 350 and all(got[k] == got[k + 1] for k in near)
