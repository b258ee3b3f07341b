"""Every operator against brute force on small tables with nulls, ties, repeats and long texts."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from icupanel.llm import chat, decontaminate, licenses, lines, mixing, quality, sharding, simhash, tokens, topk
from icupanel.llm.common import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def documents(seed=1, n=60):
    rng = random.Random(seed)
    texts = [prose(rng, rng.choice([0, 1, 2, 5, 40, 120])) for _ in range(n)]
    texts += [texts[5]] * 4 + [texts[6] + " tail", "", None, "é" * 50, "x " * 3000]
    return [(i, t, "en", "hot" if i % 3 else f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)] + [(3, texts[3], "en", "s3", 1), (None, "no id", "en", None, 5)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- chat -----------------------------------------------------------------

def test_chat_rotation(spark):
    rows = [(1, 0, "system", "be brief"), (1, 1, "ann", "hi <|end|> \\"), (1, 2, "bob", None), (1, 2, None, "tie"), (2, 0, "system", "alone"), (None, None, "ann", "x"), (1, 600, "ann", "late")]
    got = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.conv_id is None, r.conv_id, r.perspective, r.position)):
        by[r.conv_id, r.perspective].append(r)
    assert set(by) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann")}
    for (_, person), segs in by.items():
        text = "".join(s.segment for s in segs)
        assert [s.position for s in segs] == list(range(len(segs)))
        for s in segs:
            assert text[s.start : s.stop] == s.segment
            assert s.chat_role == ("system" if s.speaker == "system" else "assistant" if s.speaker == person else "user")
            assert (s.name is None) == (s.chat_role != "user")
            if s.chat_role == "assistant":
                assert text[s.loss_start : s.loss_stop].endswith("<|end|>") and text[s.start : s.loss_start] == "<|start|>assistant\n"
            else:
                assert s.loss_start is None
        assert text.count("<|end|>\n") == len(segs)
    assert "hi <\\|end|> \\\\" in by[1, "ann"][1].segment
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# --- licenses -------------------------------------------------------------

def test_licenses(spark):
    full = licenses.TEMPLATES["MIT"][2]
    rows = [
        (1, "Some words.\nReleased under the MIT License.\nMore words."), (2, "This work is licensed under the GNU General Public License, version 3."),
        (3, "This work is licensed under the GNU General Public License, version 2."), (4, "Licensed under CC BY-NC 4.0."), (5, "Licensed under CC BY 4.0."), (6, None), (7, ""),
        (8, "my driving license was lost, with no copyright at all"), (9, prose(random.Random(3), 3000) + ". Licensed under the Apache License, Version 2.0. " + prose(random.Random(4), 3000)),
        (10, full.replace("free of charge", "free of any charge")), (None, "Licensed under CC BY-SA 4.0."), (1, "Released under the MIT License.")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.license) for r in got) == Counter({
        (1, "MIT"): 2, (2, "GPL-3.0"): 1, (3, "GPL-2.0"): 1, (4, "CC-BY-NC-4.0"): 1, (5, "CC-BY-4.0"): 1, (9, "Apache-2.0"): 1, (10, "MIT"): 1, (None, "CC-BY-SA-4.0"): 1})
    assert next(r for r in got if r.doc_id == 10).added == ["any"]
    assert all(0 < r.reduction <= r.alone for r in got)


def test_license_templates_verbatim_and_wrapped(spark):
    import textwrap

    rows, names = [], []
    for name, ts in licenses.TEMPLATES.items():
        for t in ts:
            for form in (t, textwrap.fill(t, 28), "Some code.\n\n" + "\n".join("# " + x for x in textwrap.wrap(t, 50)) + "\n\nint main() {}"):
                rows.append((len(rows), form))
                names.append(name)
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.license) for r in got) == Counter(enumerate(names))


def test_separate_notices_of_one_license(spark):
    short, full = licenses.TEMPLATES["Apache-2.0"]
    filler = prose(random.Random(8), 200)
    d = spark.createDataFrame([(1, f"{short} {filler}. {full}. {filler}. {full}.")], "doc_id long, text string")
    assert [r.template for r in licenses.scan(d).collect()] == [short, full, full]


def test_own_templates_and_all_ranked(spark):
    """A caller's template is found without a cue word; comparing all templates changes nothing; an empty table gives no rows."""
    own = {"House": ("Any reuse of these pages outside the house needs a written note from the editor in charge of them",)}
    text = prose(random.Random(9), 50) + ". " + own["House"][0] + ". " + prose(random.Random(10), 50)
    d = spark.createDataFrame([(1, text), (2, prose(random.Random(11), 80)), (3, None)], "doc_id long, text string")
    assert [(r.doc_id, r.license) for r in licenses.scan(d, own).collect()] == [(1, "House")]
    rows = [(k, t.replace("the", "this", 1)) for k, t in enumerate(t for ts in licenses.TEMPLATES.values() for t in ts)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    some, every = (sorted(map(str, licenses.scan(d, ranked=n).collect())) for n in (3, 100))
    assert some == every and len(some) > 10
    assert licenses.scan(d.limit(0)).count() == 0


# --- quality --------------------------------------------------------------

def test_quality(spark, docs, empty):
    rng = random.Random(5)
    rows = [(i, prose(rng, 60) + "." if i % 3 else " ".join(w.upper() + "!!" for w in prose(rng, 60).split()), None, None, 0) for i in range(300)]
    d = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(None, 1, 0), (7, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(d, labels)
    got = quality.scored(d.withColumn("hold", quality.held_out(F.col("doc_id"))), model).collect()
    assert {r.hold == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got} == {True}
    assert all(r.predicted == int(r.doc_id % 3 > 0) for r in got)
    out = quality.scored(docs, model).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    assert quality.scored(empty, model).count() == 0
    assert quality.train(empty, labels).score(np.zeros((1, len(quality.FEATURES))))[0] == 0.5


def test_quality_pairs():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.fit(x, y, pair_rounds=60)
    assert ((m.score(x) > 0.5) == y).mean() > 0.9 and (0, 1) in {(i, j) for i, j, _ in m.pairs}


def test_quality_score_by_table_lookups(spark):
    """Scores are sums of one cell of every table, found by plain loops; a null text scores as an empty one."""
    rng = random.Random(6)
    texts = [prose(rng, rng.randrange(1, 90)) + rng.choice([".", "!!", "| |", " ÄÖ"]) for _ in range(200)]
    x = np.array([quality.features(t) for t in texts])
    model = quality.fit(x, np.array([float("!" in t or "|" in t) for t in texts]), rounds=20, pair_rounds=10)
    asked = [*texts[:40], "", None, "word " * 60_000]

    def slow(text):
        f = quality.features(text)
        bins = [sum(e <= v for e in edges) for v, edges in zip(f.tolist(), model.edges)]
        odds = model.intercept + sum(t[k] for t, k in zip(model.tables, bins)) + sum(t[bins[i], bins[j]] for i, j, t in model.pairs)
        return 1 / (1 + math.exp(-odds))

    got = {r.doc_id: r for r in quality.scored(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).collect()}
    assert len(model.pairs) > 0 and all(abs(got[i].score - slow(t)) < 1e-9 for i, t in enumerate(asked))
    assert got[40].score == got[41].score and all(r.predicted == int(r.score >= 0.3) for r in got.values())


# --- mixing ---------------------------------------------------------------

def test_mixing(spark, docs, empty):
    got = mixing.poisson_mix(docs, {"hot": 1.0, "s0": 3.0}, budget=2.0).collect()
    again = mixing.poisson_mix(docs.repartition(7), {"hot": 1.0, "s0": 3.0}, budget=2.0).collect()
    assert Counter(map(str, got)) == Counter(map(str, again))
    assert {r.source for r in got} <= {"hot", "s0"}
    sizes = Counter()
    for _, t, _, s, _ in documents():
        sizes[s] += len((t or "").encode())
    rate = {s: 2.0 * sum(sizes.values()) * w / 4 / sizes[s] for s, w in (("hot", 1.0), ("s0", 3.0))}
    counts = {(r.doc_id, r.text): r.n_copies for r in got}
    import hashlib

    for i, t, _, s, _ in documents():
        if s not in rate:
            continue
        draws = max(1, math.ceil(rate[s] / mixing.LARGEST_MEAN))
        k = 0
        for j in range(1, draws + 1):
            u, mean = int(hashlib.md5(f"17|{j}|{i}".encode()).hexdigest()[:13], 16) / (1 << 52), rate[s] / draws
            p = c = math.exp(-mean)
            n = 0
            while c <= u:
                n += 1
                p *= mean / n
                c += p
            k += n
        assert counts.get((i, t), 0) == k
    assert mixing.poisson_mix(empty).count() == 0


def test_mixing_large_mean(spark):
    rows = [(i, "a" * (1 if i == 0 else 4000), None, "tiny" if i == 0 else "big", 0) for i in range(3)]
    got = mixing.poisson_mix(spark.createDataFrame(rows, DOCS), {"tiny": 1.0, "big": 1.0})
    n = got.where("source = 'tiny'").count()
    assert 3700 < n < 4300 and got.where("source = 'tiny'").agg(F.countDistinct("copy_no")).first()[0] == n


# --- tokens ---------------------------------------------------------------

def test_tokens(spark, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Hello world's  first\n\n token", "", None, "a<|endoftext|> b <|endoftext|>", "日本語 ñandú 12345 ½ ²", "  lead\t\ttabs \x85 nbsp\xa0x \x1c y", "x" * 5000, "the " * 4000, "don't I'LL we've", "​ zero", "emoji 👩‍👩‍👧 ok"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (None, "null id"), (3, "other text of three")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    tk = Tokenizer.from_file(path)
    want = Counter((i, len((t or "").encode()), n := len(tk.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in rows)
    for common in (0, 3, 300_000):
        got = Counter(tuple(r) for r in tokens.count_tokens(d, path, common=common).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect())
        assert got == want
    assert tokens.count_tokens(empty, path).count() == 0


# --- sharding -------------------------------------------------------------

@pytest.mark.parametrize("tolerance", [0.0, 0.3])
def test_sharding(spark, docs, empty, tolerance):
    got = sharding.shard(docs, 6, blocks=3, tolerance=tolerance).collect()
    assert len(got) == docs.count()
    total = sum(r["size"] for r in got)
    largest = max(sum(r["size"] for r in got if r.text == x.text and r.doc_id == x.doc_id) for x in got)
    by = defaultdict(list)
    for r in got:
        assert r["size"] == len((r.text or "").encode()) + 16
        by[r["shard"]].append(r)
    for s, rows in by.items():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        assert abs(sum(r["size"] for r in rows) - total / 6) <= largest + 2 * tolerance * total / 6
    assert sharding.shard(empty, 6).count() == 0


def test_sharding_midpoint_rule(spark):
    rng = random.Random(2)
    rows = [(i, "copy" if i % 2 else prose(rng, i % 30), None, None, 0) for i in range(200)]
    got = {r.doc_id: r.shard for r in sharding.shard(spark.createDataFrame(rows, DOCS), 5, blocks=2).collect()}
    import hashlib

    order = sorted((int(hashlib.md5(t.encode()).hexdigest()[:15], 16), i, len(t) + 16) for i, t, *_ in rows)
    total, below = sum(x[2] for x in order), 0
    for _, i, n in order:
        assert got[i] == (2 * below + n) * 5 // (2 * total)
        below += n


# --- simhash --------------------------------------------------------------

def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    ones = [sum(xxhash.xxh64_intdigest(s, 42) >> j & 1 for s in sh) for j in range(64)]
    return sum(1 << j for j in range(64) if 2 * ones[j] > len(sh))


def components(nodes, near):
    par = {x: x for x in nodes}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if near(a, b):
                x, y = find(a), find(b)
                par[max(x, y)] = min(x, y)
    return {x: find(x) for x in nodes}


def test_near_duplicates(spark, docs, empty):
    got = simhash.near_duplicates(docs).collect()
    rows = documents()
    fps = {(i, t): slow_fingerprint(t) for i, t, *_ in rows}
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((i, f"{fps[i, t]:016x}") for i, t, *_ in rows)
    classes = components(sorted(set(fps.values())), lambda a, b: (a ^ b).bit_count() <= 2)
    first = {}
    for (i, _), f in fps.items():
        if i is not None:
            first[classes[f]] = min(i, first.get(classes[f], i))
    assert {(r.doc_id, r.component_id) for r in got} == {(i, first.get(classes[f])) for (i, _), f in fps.items()}
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one_per_group(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == set(first.values())


@pytest.mark.parametrize(("radius", "bucket_limit", "scale"), [(2, 4096, None), (2, 3, None), (1, 4096, None), (2, 4096, 10**10), (3, 4096, 10**8)])
def test_link(spark, radius, bucket_limit, scale):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base[:15]:
        x = b
        for _ in range(6):  # chains whose ends are far apart
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    got = simhash.link(spark.createDataFrame([(x,) for x in signed], "fp long"), radius, bucket_limit, scale).collect()
    near = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= radius
    assert all(near(r.a, r.b) for r in got)
    par = components(signed, near)
    pairs = {(r.a, r.b) for r in got}
    assert components(signed, lambda a, b: (a, b) in pairs or (b, a) in pairs) == par


def test_plan_is_unequal_at_scale():
    rng = np.random.default_rng(1)
    bits = (rng.random((2000, 64)) < 0.5).astype(np.int64)
    together = bits.T @ bits
    for n in (2000, 10**7, 10**11):
        chosen = simhash.plan(n, np.rint(together * (n / 2000)).astype(np.int64), 2)
        parts = simhash.BITS // max(len(g) for g, _ in chosen)
        assert chosen and sum(t + 1 for _, t in chosen) == 3 and parts >= 1


def test_components_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}
    assert connected_components(edges.where("a < 0")).count() == 0


# --- decontamination ------------------------------------------------------

def test_decontamination(spark, docs, empty):
    rng = random.Random(11)
    items = [(i, prose(rng, n, 5000)) for i, n in enumerate([3, 8, 16, 30, 31, 55, 60])]
    planted = []
    for i, t in items:
        w = t.split()
        planted.append((100 + i, prose(rng, 70) + " " + t.upper() + ", " + prose(rng, 50)))
        planted.append((200 + i, t))
        planted.append((800 + i, prose(rng, 5) + " “" + t + "”— " + prose(rng, 5)))
        if len(w) >= 30:
            near = [*w]
            near[len(w) // 2] = "changed"
            planted.append((300 + i, prose(rng, 33) + " " + " ".join(near) + " " + prose(rng, 9)))
            planted.append((400 + i, prose(rng, 20) + " " + " ".join(w[: len(w) // 2])))
    planted += [(500, prose(rng, 30_000) + " " + items[5][1] + " " + prose(rng, 30_000)), (600, None), (601, ""), (None, items[6][1]), (700, items[2][1] + " " + items[3][1])]
    bench = spark.createDataFrame([*items, (90, None), (91, "...")], "item_id long, text string")
    d = spark.createDataFrame(planted, "doc_id long, text string")
    got = decontaminate.find_passages(d, bench).collect()
    want = {(k + i, i) for k in (100, 200, 800) for i, _ in items} | {(500, 5), (None, 6), (700, 2), (700, 3)}
    found = {(r.doc_id, r.item_id) for r in got}
    assert want <= found
    sets = {i: {" ".join(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t in items}
    for i, t in items:
        if len(t.split()) >= 30:  # one changed word costs five shingles
            n = len(sets[i])
            assert ((300 + i, i) in found) == ((n - 5) / (n + 5) >= 0.8)
    assert not any(r.doc_id and 400 <= r.doc_id < 500 for r in got)
    assert all(r.similarity == 1.0 for r in got if (r.doc_id, r.item_id) in want)
    assert {(r.doc_id, r.start) for r in got if r.item_id == 5 and r.doc_id in (105, 500)} == {(105, 70), (500, 30_000)}
    several = decontaminate.find_passages(d, bench, items_a_pass=2).collect()
    assert {(r.doc_id, r.item_id) for r in several} >= want
    clean = decontaminate.decontaminate(d, bench)
    assert {r.doc_id for r in clean.collect()} == {r for r, _ in planted} - {x for x, _ in found}
    assert decontaminate.find_passages(empty, bench).count() == 0 and decontaminate.find_passages(docs, bench.limit(0)).count() == 0


def test_decontamination_over_passes(spark):
    """Weights are those of the whole benchmark in every pass; items without an id are found; sums may wrap."""
    rng = random.Random(12)
    shared = prose(rng, 25, 5000)
    items = [(i, shared + " " + prose(rng, 25, 5000)) for i in range(12)] + [(None, prose(rng, 40, 5000))]
    texts = [(i, " ".join(w if k not in (30, 38) else "odd" for k, w in enumerate(t.split()))) for i, t in items] + [(50, items[12][1]), (51, items[3][1])]
    bench, d = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(texts, "doc_id long, text string")
    one, several = ({tuple(r) for r in decontaminate.find_passages(d, bench, similarity=0.3, items_a_pass=n).collect()} for n in (100, 2))
    assert one == several and (50, None, 1.0, 0) in one and (51, 3, 1.0, 0) in one
    sums = np.array([[32767] * 128, [-32768 + 9] * 128], np.int16)
    assert (decontaminate._prints(sums, np.array([0]), np.array([1])) == np.uint64(2**64 - 1)).all()


def test_decontamination_of_repeated_ids(spark):
    """Rows of one item_id give one row a document, the best, in however many passes; items without an id stay apart."""
    rng = random.Random(14)
    first, second, other = (prose(rng, 40, 5000) for _ in range(3))
    near = " ".join("odd" if k == 20 else w for k, w in enumerate(first.split()))
    items = [(1, near), (1, first), (2, second), (None, other), (None, other)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame([(10, first), (11, second + " " + other), (12, prose(rng, 50, 5000)), (11, second)], "doc_id long, text string")
    got = [sorted(map(str, decontaminate.find_passages(d, bench, items_a_pass=n).collect())) for n in (1, 2, 100)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 5
    assert "similarity=1.0" in got[0][0] and "doc_id=10" in got[0][0]


def test_decontamination_against_all_windows(spark):
    """Links and similarities of every window of every item's length, by loops."""
    rng = random.Random(15)
    items = [(i, prose(rng, rng.choice([30, 45, 60, 120]), 3000)) for i in range(10)]
    texts = []
    for i in range(60):
        w = items[i % 10][1].split()
        kind = i // 10
        if kind == 0:
            w = w[: len(w) * 9 // 10]
        elif kind == 1:
            w = w[len(w) // 12 :]
        elif kind < 5:
            for _ in range(kind - 1):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        texts.append((i, " ".join([prose(rng, rng.randrange(40), 3000), *w, prose(rng, rng.randrange(40), 3000)]).strip()))
    grams = lambda w: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    sets = {i: grams(t.split()) for i, t in items}
    held = Counter(s for c in sets.values() for s in c)
    weight = lambda s: math.log1p(len(items) / held[s]) if s in held else math.log1p(len(items))
    want = {}
    for d, t in texts:
        w = t.split()
        for i, item in items:
            n = len(item.split())
            for y in range(max(1, len(w) - n + 1)):
                c = grams(w[y : y + n])
                both = sum((c & sets[i])[s] * weight(s) for s in c & sets[i])
                whole = sum(k * weight(s) for s, k in (c | sets[i]).items())
                if both >= 0.8 * whole - 1e-12:
                    want[d, i] = max(want.get((d, i), 0), both / whole)
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_passages(
        spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) <= set(want) and len(got) >= 0.99 * len(want) and len(want) > 20
    assert all(abs(want[k] - v) < 1e-5 for k, v in got.items())


# --- lines ----------------------------------------------------------------

def shingle_set(line):
    raw = line.encode()
    return {raw[i : i + 5] for i in range(max(1, len(raw) - 4))}


def test_lines(spark, empty):
    rng = random.Random(13)
    texts = []
    for n in (1, 2, 4, 8, 20, 40, 90):
        for _ in range(6):
            line = prose(rng, n, 10_000)
            w = line.split()
            w[-1] = "zz"
            texts.append("\n".join([line, "", "  ", " ".join(w), line]))
    texts += ["abc\nabd\nabc", None, "", "\n\n", "é" * 300 + "\n" + "é" * 299 + "x", "hot line of all documents"] + ["hot line of all documents\nhot line of all documents!"] * 30
    rows = [(i, t) for i, t in enumerate(texts)]
    got = lines.near_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(i, k, x) for i, t in rows for k, x in enumerate((t or "").split("\n")) if x.strip(" ")]
    assert Counter((r.doc_id, r.line_no) for r in got) == Counter((i, k) for i, k, _ in want)
    text_of = {(i, k): x for i, k, x in want}
    ids = {text_of[r.doc_id, r.line_no]: r.line_id for r in got}
    sets = {h: shingle_set(x) for x, h in ids.items()}

    def near(a, b):
        both = len(sets[a] & sets[b])
        return both >= 0.8 * (len(sets[a]) + len(sets[b]) - both)

    classes = components(sorted(sets), near)
    wrong = sum(classes[r.line_id] != r.component_id for r in got)
    assert wrong <= 0.01 * len(got)
    firsts = {}
    for r in got:
        firsts[r.component_id] = min(firsts.get(r.component_id, (10**9, 0)), (r.doc_id, r.line_no))
    assert all(r.kept == (firsts[r.component_id] == (r.doc_id, r.line_no)) for r in got)
    assert lines.near_lines(empty).count() == 0
    out = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows[-8:] + [(1000, None)], "doc_id long, text string")).collect()}
    assert out[1000] is None and sum("hot" in (t or "") for t in out.values()) == 1


def test_lines_of_equal_sets(spark):
    """Lines of one set of shingles meet whatever their lengths."""
    texts = [c * n for c in ("-", "=+", "ha ", "| --- ") for n in (10, 40, 90, 200, 500)]
    got = lines.near_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len({r.component_id for r in got}) == 4 and sum(r.kept for r in got) == 4


def test_lines_of_one_bucket(spark, monkeypatch):
    """Similar lines of a large bucket are linked though no other of its lines is like them."""
    rng = random.Random(17)
    texts = [prose(rng, 12, 10**6) for _ in range(300)]
    texts += [t + "x" for t in texts[:100]]
    n = F.greatest(F.lit(1), F.octet_length("line") - 4)
    monkeypatch.setattr(lines, "band_keys", lambda d: d.select("line_id", n.alias("n"), F.lit(1).cast("long").alias("key")))
    got = lines.near_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len({r.component_id for r in got}) == 300 and sum(r.kept for r in got) == 300


def test_lines_of_one_doc_id(spark):
    """Texts under one doc_id lose their own copies only."""
    shared = "a line that both of these texts hold"
    rows = [(5, "first own line of alpha quite unlike\n" + shared), (5, shared + "\nsecond own line of gamma entirely different"), (5, None), (None, shared)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("extra") for c in ("text_id", "line", "key", "size", "hot", "keys", "raw")})
    out = [r.text for r in lines.dedup_lines(d).collect()]
    left = [x for t in out for x in (t or "").split("\n") if x]
    assert len(out) == 4 and left.count(shared) == 1
    assert {"first own line of alpha quite unlike", "second own line of gamma entirely different"} <= set(left)


def test_long_lines_by_brute_force(spark):
    """Edited long lines: links of similarity 0.8 or more are found as good as always, others never."""
    rng = random.Random(19)
    texts = []
    for n in (30, 60, 120, 250, 600):
        for _ in range(12):
            w = prose(rng, n, 10**5).split()
            texts.append(" ".join(w))
            for share in (0.02, 0.05, 0.08):
                texts.append(" ".join(f"e{rng.randrange(10**5)}" if rng.random() < share else x for x in w))
    texts += ["a passage that very many lines share, word for word, " * 2 + prose(rng, 30, 10**5) for _ in range(40)]
    got = {r.line_id: r.component_id for r in lines.near_lines(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    sets = {xxhash.xxh64_intdigest(t.encode(), 42): shingle_set(t) for t in texts}
    sets = {(h - (1 << 64) if h >> 63 else h): s for h, s in sets.items()}

    def near(a, b):
        both = len(sets[a] & sets[b])
        return both >= 0.8 * (len(sets[a]) + len(sets[b]) - both)

    want = components(sorted(sets), near)
    assert set(got) == set(want) and sum(got[x] != want[x] for x in want) <= 0.02 * len(want)


# --- top-k ----------------------------------------------------------------

def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.2, 8)], 0) for i in range(400)]
    rows += [(50, None, 0), (401, [float("nan")] * 8, 0), (402, [1.0, None], 0), (403, [float("inf")] * 8, 0), (404, [0.5, -0.5], 0), (405, [], 0), (None, [1.0] * 8, 0)]
    rows += [(406 + i, rows[7][1], 0) for i in range(20)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = topk.top_k(d, F.col("vec_id") % 50 == 0, index_block=100, query_block=3).collect()
    v = {i: [math.floor(256 * float(np.float32(x))) for x in e] for i, e, _ in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)}
    want = set()
    for q in (i for i in v if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q)[:5]
        want |= {(q, k + 1, c, -s) for k, (s, c) in enumerate(best)}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want and len(got) == len(want)
    assert topk.top_k(d.where("vec_id < 3"), F.col("vec_id") == 0).count() == 2
    assert topk.top_k(d.limit(0), F.col("vec_id") == 0).count() == 0
    crowded = d.withColumns({n: F.lit("extra") for n in ("deal", "ids", "vector", "width", "score", "query_id", "rank")})
    assert Counter(topk.top_k(crowded, F.col("vec_id") % 50 == 0, index_block=100).collect()) == Counter(got)


def test_top_k_of_null_and_equal_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    nothing = spark.createDataFrame([(0, None), (1, [None]), (None, [1.0])], schema)
    assert topk.top_k(nothing, F.lit(True)).count() == 0
    same = spark.createDataFrame([(i, [0.25, -0.5]) for i in (0, 3, 3, 2, 9, 7)] + [(50, None), (0, [0.25, -0.5])], schema)
    got = topk.top_k(same, F.col("vec_id") % 50 == 0, k=3).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 2, 20480), (0, 2, 3, 20480), (0, 3, 3, 20480)]


@pytest.mark.parametrize("bits", [1, 3, 6, 8])
def test_impact_order_stops_on_proof(bits):
    """Exact at every coarseness; queries with few heavy components read a part of the postings, and never more than those with an impact."""
    rng = np.random.default_rng(bits)
    n, dims = 1500, 24
    block = np.floor(rng.normal(0, 40, (n, dims)) * rng.uniform(0, 3, dims)).astype(np.int64)
    block[:, 3] = 7
    block[100:160] = block[100]
    ids = rng.permutation(n).astype(np.int64)
    ids[:5] = ids[5]
    postings = topk.invert(block, bits)
    assert postings.counts.sum() == n * dims
    for i in range(0, n, 30):
        query = block[i] * (rng.random(dims) < (0.2 if i % 60 else 1))
        found = topk.search(block, ids, postings, query, ids[i], 5, few=8, turn=1)
        scores = block @ query
        want = sorted((-s, v) for s, v in zip(scores.tolist(), ids.tolist()) if v != ids[i])[:5]
        assert list(zip((-found.scores).tolist(), found.ids.tolist())) == want
        assert found.read <= n * np.count_nonzero(query) and found.rescored >= 5
    heavy = np.zeros(dims, np.int64)
    heavy[5], heavy[6] = -1000, 1
    assert topk.search(block, ids, postings, heavy, -1, 5, few=8, turn=1).read < 2 * n or bits == 1


# --- columns --------------------------------------------------------------

def test_clashing_columns(spark, docs):
    """Extra columns under the names that operators use change no result; those of outputs are replaced."""
    names = "score predicted size shard slot n_copies copy_no shuffle_key fp key line line_no draws cdf bucket piece pieces hash row h id y x".split()
    crowded = docs.withColumns({n: F.lit("extra") for n in names})
    bench = spark.createDataFrame([(1, documents()[62][1])], "item_id long, text string").withColumn("key", F.lit("extra"))
    model = quality.Model()
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    for run, columns in (
        (lambda d: quality.scored(d, model), ["doc_id", "score", "predicted"]), (mixing.poisson_mix, ["doc_id", "n_copies", "copy_no", "shuffle_key"]),
        (lambda d: sharding.shard(d, 4), ["doc_id", "size", "shard"]), (simhash.near_duplicates, ["doc_id", "component_id"]), (simhash.keep_one_per_group, ["doc_id"]),
        (lambda d: decontaminate.find_passages(d, bench), ["doc_id", "item_id"]), (lambda d: decontaminate.decontaminate(d, bench), ["doc_id"]),
        (licenses.scan, ["doc_id"]), (lambda d: tokens.count_tokens(d, path), ["doc_id", "n_tokens"]), (lines.near_lines, ["doc_id", "line_no", "component_id"]),
    ):
        a, b = (Counter(map(tuple, run(d).select(*columns).collect())) for d in (docs, crowded))
        assert a == b
    kept = mixing.poisson_mix(crowded)
    assert set(crowded.columns) <= set(kept.columns) and kept.where("bucket <> 'extra'").count() == 0
