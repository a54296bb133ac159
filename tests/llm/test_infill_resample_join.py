"""Fill-in-the-middle, importance resampling and the grouped prefix join against brute force, and their odd cases."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F
from test_llm_operators import LONG, ODD, clashing, docs

from terrashift.llm import fill_middle, prefix_join, resample
from terrashift.llm.registry import queries

# --- 11 fill in the middle

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def brute_fill(key, text, seed=1, rate=90, spm=20):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(s in text for s in fill_middle.SENTINELS) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_texts(n=400, seed=5):
    rng = random.Random(seed)
    parts = ["a", "Zed", "word", " ", "\n", "\0", "<", ">", "<P", "P>", "S>", "é", "漢", "😀", "́", "7", "-", "<P>", "<<S>", "\x7f", "_", "ſ", "K"]
    return ["".join(rng.choices(parts, k=rng.choice([0, 1, 2, 3, 9, 40]))) for _ in range(n)]


def test_fill_middle_equals_brute_force(spark):
    texts = [*odd_texts(), LONG, "x" * 300_000, "漢" * 100_000, "1" * 1000 + "a", None]
    rows = [(k if k % 50 else None, t, "en", "s", 0) for k, t in enumerate(texts)]
    found = fill_middle.fill_middle(clashing(docs(spark, rows)), batch_chars=1000).withColumn("again", fill_middle.restored())
    got = sorted(((r.doc_id, r.text), (r.n_units, r.form, r.prefix_chars, r.middle_chars, r.output), r.again) for r in found.collect() if r.doc_id is not None and r.text is not None)
    want = sorted(((k, t), brute_fill(k, t), t) for k, t, *_ in rows if k is not None and t is not None)
    assert got == want
    assert {x[1][1] for x in got} == {"plain", "psm", "spm"}
    rest = [r for r in found.collect() if r.doc_id is None or r.text is None]
    assert all((r.n_units, r.form, r.prefix_chars, r.middle_chars, r.output) == brute_fill(r.doc_id, r.text) and r.again == (r.text or "") for r in rest) and rest


def test_every_rank_of_units():
    machine = fill_middle.event_automaton(fill_middle.SENTINELS)
    for text in odd_texts(200, 8):
        units, parts = fill_middle.Units(text, machine), UNIT.findall(text)
        assert units.n == len(parts)
        assert [units.end_of(r) for r in range(units.n + 1)] == [len("".join(parts[:r])) for r in range(len(parts) + 1)]
        assert units.holds_sentinel == any(s in text for s in fill_middle.SENTINELS)


def test_fill_middle_keeps_rows_and_columns(spark):
    found = fill_middle.fill_middle(clashing(docs(spark)).withColumns({"form": F.lit(1), "output": F.lit(2)}))
    assert found.count() == len(ODD) and set(clashing(docs(spark)).columns) <= set(found.columns)
    assert dict(found.dtypes)["output"] == "string"
    assert fill_middle.fill_middle(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        fill_middle.fill_middle(docs(spark).withColumnRenamed("text", "form"), text="form")
    with pytest.raises(ValueError):
        fill_middle.event_automaton(("<P>", "<S>", "|"))


def test_other_sentinels_are_restored(spark):
    marks = ("<|prefix|>", "<|suffix|>", "<|mid|>")
    found = fill_middle.fill_middle(docs(spark, [(k, f"some text {k}, with <P> in it", "en", "s", 1) for k in range(60)]), seed=9, sentinels=marks, rate=100, spm_rate=50)
    rows = found.withColumn("again", fill_middle.restored(sentinels=marks)).collect()
    assert {r.form for r in rows} == {"psm", "spm"} and all(r.again == r.text for r in rows)


# --- 12 importance resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, n):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[k : k + m]) for k in range(len(words)) for m in range(1, n + 1) if k + m <= len(words)]


def brute_scores(rows, target, n, buckets, seed):
    count = lambda texts: [sum(col) for col in zip(*(histogram(t) for t in texts))] if texts else [0] * buckets

    def histogram(text):
        out = [0] * buckets
        for f in features(text, n)[1]:
            out[zlib.crc32(f.encode()) % buckets] += 1
        return out

    s, t = count([x for _, x in rows]), count(target)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out = []
    for key, text in rows:
        words, found = features(text, n)
        weight = math.floor(sum(gain[zlib.crc32(f.encode()) % buckets] for f in found) / len(found)) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append((key, words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    return out


@pytest.mark.parametrize("n", [1, 2, 3])
def test_resample_equals_brute_force(spark, n):
    rng = random.Random(n)
    words = ["alpha", "Beta", "é", "漢字", "x9", "don't", "a-b", "gamma"]
    texts = [rng.choice([" ", "\n", "; "]).join(rng.choices(words, k=rng.choice([0, 1, 5, 19, 20, 30]))) for _ in range(300)] + [None, "", LONG]
    rows = [(k, t) for k, t in enumerate(texts)]
    target = [" ".join(rng.choices(words[:3], k=20)) for _ in range(10)] + [None]
    df = clashing(docs(spark, [(k, t, "en", "s", 1) for k, t in rows]))
    scored = resample.importance_scores(df, spark.createDataFrame([(t,) for t in target], "text string"), n=n, buckets=97, seed=7)
    want = brute_scores(rows, target, n, 97, 7)
    assert sorted(tuple(r[c] for c in ("doc_id", "n_words", "n_features", "weight", "score")) for r in scored.collect()) == want
    got = {r.doc_id: r["rank"] for r in resample.with_ranks(scored, 25, 20).collect()}
    held = sorted((-w[4], w[0]) for w in want if w[1] >= 20)
    order = {key: k + 1 for k, (_, key) in enumerate(held[: len(held) * 25 // 100])}
    assert got == {k: order.get(k) for k, _ in rows}


def test_ring_meets_every_run_across_pieces():
    text = " ".join(f"w{k % 37}é" for k in range(500))
    want = sorted(zlib.crc32(f.encode()) % 1000 for f in features(text, 4)[1])
    for size in (1, 7, 100, 1 << 20):
        count, found = resample.ring_buckets(resample.word_pieces(text, size), 4, 1000)
        assert count == 500 and sorted(found.tolist()) == want


def test_resample_odd_cases(spark):
    target = spark.createDataFrame([("several words here",)], "text string")
    scored = resample.importance_scores(clashing(docs(spark)), target)
    rows = resample.with_ranks(scored, 100, 5).collect()
    assert len(rows) == len(ODD)
    held = [r for r in rows if r.n_words >= 5]
    assert sorted(r["rank"] for r in held) == list(range(1, len(held) + 1)) and all(r["rank"] is None for r in rows if r.n_words < 5)
    assert all((r.n_features, r.weight) == (0, 0) for r in rows if r.doc_id in (1, 2, 3))
    assert resample.with_ranks(scored, 0).where("rank is not null").count() == 0
    assert resample.with_ranks(resample.importance_scores(docs(spark, []), target)).count() == 0
    assert resample.importance_scores(docs(spark), target.limit(0)).count() == len(ODD)
    assert {r.doc_id for r in resample.resampled(clashing(docs(spark)), target, 100, 5).collect()} == {None, 5, 6, 7}


def test_ties_go_to_the_smaller_id(spark):
    scored = spark.createDataFrame([(k, 30, 1, 0, s) for k, s in [(9, 5), (3, 5), (None, 5), (7, 8), (3, 5), (1, 2)]], "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")
    got = sorted((r["rank"], r.doc_id) for r in resample.with_ranks(scored, 84).collect() if r["rank"])
    assert got == [(1, 7), (2, 3), (3, 3), (4, 9), (5, None)]


# --- 13 grouped prefix join


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def brute_join(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for k, (key, _) in enumerate(rows):
        if key is not None:
            least[root(k)] = min(key, least.get(root(k), key))
    return sorted(((key, len(sets[k]), least.get(root(k))) for k, (key, _) in enumerate(rows)), key=str)


def family(rng, n, length, edits, vocabulary):
    base = rng.choices(vocabulary, k=length)
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(edits + 1)):
            k = rng.randrange(len(words) or 1)
            words[k : k + 1] = rng.choice([[], [rng.choice(vocabulary)], words[k : k + 1] * 2])
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("seed, hot, cell, percent", [(1, 8, 2048, 85), (2, 2, 4, 85), (3, 3, 8, 80), (4, 8, 16, 95), (5, 2, 4, 100)])
def test_prefix_join_equals_brute_force(spark, seed, hot, cell, percent):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = []
    for length in (3, 4, 5, 9, 24, 60, 60, 150):
        texts += family(rng, 30, length, 4, vocabulary)
    texts += family(rng, 40, 80, 12, vocabulary) + ["Boiler Plate of FIVE words " * 3 + x for x in rng.choices(vocabulary, k=20)] + [None, "", " \n"]
    rng.shuffle(texts)
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (4, texts[9]), (None, texts[5])]
    df = clashing(docs(spark, [(k, t, "en", "s", 1) for k, t in rows]).repartition(3))
    found = prefix_join.jaccard_components(df, width=4, percent=percent, hot=hot, cell=cell)
    assert sorted(((r.doc_id, r.n, r.component_id) for r in found.collect()), key=str) == brute_join(rows, 4, percent)


def test_prefixes_meet_at_the_threshold():
    """Sets at the very threshold share a key of their prefixes, in the smaller one's shorter prefix."""
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(300):
        n, percent = int(rng.integers(1, 120)), int(rng.choice([80, 85, 90]))
        m = int(rng.integers(n, n * 100 // percent + 1))
        common = -(-percent * (n + m) // (100 + percent))
        if common > n:
            continue
        every = rng.integers(0, 1 << 63, n + m - common, dtype=np.uint64)
        a, b = np.sort(every[:n]), np.sort(every[n - common :])
        levels = rng.integers(0, 9, 1 << 12).astype(np.uint8)
        x, y = prefix_join.prefix(a, percent, levels), prefix_join.prefix(b, percent, levels)
        short = n - -(-2 * percent * n // (100 + percent)) + 1
        assert np.isin(x[:short], y).any()


def test_prefix_join_odd_cases(spark):
    got = sorted(((r.doc_id, r.n, r.component_id) for r in prefix_join.jaccard_components(clashing(docs(spark))).collect()), key=str)
    assert got == brute_join([(r[0], r[1]) for r in ODD], 4, 85) or got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 5, 5), (5, 5, 5), (6, 5, 5), (7, 3, 7), (None, 2, None)], key=str)
    assert prefix_join.jaccard_components(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        prefix_join.jaccard_components(docs(spark), percent=50)


def test_prefix_join_query_equals_brute_force(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    found = queries()["op13_prefix_join"](spark, data).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == brute_join(rows, 4, 85)
