"""Prefix trie, lexical search and fingerprints against brute force, on odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import fingerprint, lexical, prefix_trie

TURNS = "conv_id long, turn long, role string, text string, seq int, part string"


def _nodes(turns, graft):
    by = collections.defaultdict(list)
    for c, t, r, x, *_ in turns:
        if c is not None:
            by[c].append((t is not None, t or 0, r or "", x or ""))
    seqs = {c: [a[2:] for a in sorted(v, key=lambda a: a[:2])] for c, v in by.items()}
    if graft:
        seqs = {c: seqs.get(c - c % 5, [])[: (h := zlib.crc32(str(c).encode()) % 9)] + s[h:] for c, s in seqs.items()}
    held, kids = collections.defaultdict(list), collections.defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            held[tuple(s[:d])].append(c)
    for p in held:
        if p:
            kids[p[:-1]].append(p)
    out = []

    def below(p):
        leaves, saved = 0 if kids[p] else 1, (len(held[p]) - 1) * len(p[-1][1].encode()) if p else 0
        for k in kids[p]:
            a, b = below(k)
            leaves, saved = leaves + a, saved + b
        ends = ",".join(str(c) for c in sorted(held[p]) if len(seqs[c]) == len(p))
        out.append((min(held[p]), len(p), min(held[p[:-1]]) if p else None, len(held[p]), len(kids[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if held:
        below(())
    return sorted(out, key=str)


def _turns(seed, n=150):
    r, rows = random.Random(seed), []
    for c in range(n):
        for t in range(r.randint(1, 9)):
            x = r.choice(["a", "b", "é" * 3, None]) if r.random() < 0.8 else f"x{r.randrange(99)}"
            rows.append((c, t or None, r.choice(["user", None, "assistant"]), x, 1, "p"))
    return rows


@pytest.mark.parametrize("seed, graft, part_bytes", [(1, True, 10**9), (2, True, 1500), (3, False, 1500)])
def test_trie_against_brute_force(spark, seed, graft, part_bytes):
    rows = _turns(seed)
    # A third of all conversations are the same; one is long; some turns belong to none.
    rows += [(1000 + i, t, "user", "a" * t, 1, "p") for i in range(80) for t in range(4)] + [(5001, t, "user", str(t // 50), 1, "p") for t in range(120)] + [(None, 1, "user", "lost", 1, "p")] * 3
    seqs = prefix_trie.sequences(spark.createDataFrame(rows, TURNS).repartition(5))
    got = prefix_trie.trie(prefix_trie.graft(seqs) if graft else seqs, part_bytes=part_bytes)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == _nodes(rows, graft)


def test_trie_of_few_or_no_conversations(spark):
    for rows in ([], [(7, None, None, None, 1, "p")], [(5, 0, "a", "x", 1, "p"), (6, 0, "a", "x", 1, "p")]):
        seqs = prefix_trie.graft(prefix_trie.sequences(spark.createDataFrame(rows, TURNS)))
        assert sorted(map(tuple, prefix_trie.trie(seqs).collect()), key=str) == _nodes(rows, True)


def test_equal_turn_numbers_have_one_order(spark):
    rows = [(1, 0, "u", x, 1, "p") for x in "abcdef"]
    a, b = (prefix_trie.sequences(spark.createDataFrame(r, TURNS).repartition(3)).first().seq for r in (rows, rows[::-1]))
    assert a == b and len(a) == 6 * prefix_trie.TURN


def test_range_minimum_extents():
    r = np.random.default_rng(3)
    values = r.integers(-1, 6, 77)
    table = prefix_trie.RangeMin(values)
    at, d = r.integers(0, 77, 500), r.integers(0, 7, 500)
    for i, x, right, left in zip(at, d, table.right(at, d), table.left(at, d)):
        assert right == next((j for j in range(i, 77) if values[j] < x), 77)
        assert left == next((j for j in range(i, -1, -1) if values[j] < x), -1)
    end = np.array([r.integers(i + 1, 78) for i in at])
    assert list(table.least(at, end)) == [values[i:e].min() for i, e in zip(at, end)]


DOCS = "doc_id long, text string, score int, m string, h string"


def _ranked(docs, items, k):
    def terms(x):
        low = re.sub("[A-Z]", lambda c: c[0].lower(), x or "")
        return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low)

    bags = [(d[0], terms(d[1])) for d in docs]
    bags = [(i, collections.Counter(t), len(t)) for i, t in bags if t]
    n, total = len(bags), sum(b[2] for b in bags)
    df = collections.Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, x in items:
        found = []
        for i, b, size in bags:
            m = 50 + 50 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 20 * m)) for t in set(terms(x)) if t in b)
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("k, block_bytes", [(3, 10**9), (7, 300)])
def test_search_against_brute_force(spark, k, block_bytes):
    r = random.Random(k)
    words = ["the", "The", "ÉCOLE", "école", "a1", "b-2", "日本", "x_y", "q"] + [f"w{i}" for i in range(30)]
    docs = [(i if i % 11 else None, " ".join(r.choice(words) for _ in range(r.randint(1, 25))), 1, "m", "h") for i in range(300)]
    docs += [(1000 - i, "the w1 w2", 1, "m", "h") for i in range(150)] + [(5, None, 1, "m", "h"), (6, " ;\x00\t", 1, "m", "h"), (7, "the w1 w2", 1, "m", "h"), (7, "the w1 w2", 1, "m", "h"), (8, "w3 " * 20_000, 1, "m", "h")]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 12)))) for i in range(20)] + [(3, "the w1"), (3, "the w1"), (None, "w2 W2"), (50, None), (51, "nowhere"), (52, "  ")]
    got = lexical.search(spark.createDataFrame(docs, DOCS).repartition(6), spark.createDataFrame(items, "item_id long, text string"), k, block_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == _ranked(docs, items, k)


def test_search_in_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs.limit(0), items).collect() == []
    assert lexical.search(docs, items.limit(0)).collect() == []
    assert [tuple(r) for r in lexical.search(docs, items).collect()] == [(1, 1, 1, lexical.score_of(1, lexical.weight(1, 1), 100))]


def test_scores_in_slices(spark, monkeypatch):
    """However few scores and pairs a task holds at once, they are the same."""
    docs = spark.createDataFrame([(i, f"a b{i % 5} c{i % 3} d{i}") for i in range(60)], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"a b{i} c{i}") for i in range(5)], "item_id long, text string")
    whole = sorted(lexical.search(docs, items, 10).collect())
    monkeypatch.setattr(lexical, "SCORES", 4)
    monkeypatch.setattr(lexical, "PAIRS", 2)
    assert sorted(lexical.search(docs, items, 10).collect()) == whole


def _edited(rows):
    """(doc_id, text, edited text) around the ring; rows in the order of their keys."""
    for i, (doc, text) in enumerate(rows):
        after, half = rows[(i + 1) % len(rows)][1], len(text) // 2
        yield doc, text, text[: len(text) - half] + after[:half], after


@pytest.mark.parametrize("seed, part_bytes", [(1, 10**9), (2, 3000), (3, 3000)])
def test_fingerprints_around_the_ring(spark, seed, part_bytes):
    r = random.Random(seed)
    rows = [(r.choice([None, i, i, max(0, i - 3)]) if seed == 3 else i, " ".join(r.choice(["a", "bb", "é", "ccc"]) + str(r.randrange(9)) for _ in range(r.randint(0, 40))) if r.random() < 0.9 else None) for i in range(300)]
    if seed == 3:  # equal rows, more than a third of all, with and without an id
        rows += [(5, "same same")] * 1300 + [(None, None)] * 1100
    df = spark.createDataFrame([(*x, "n") for x in rows], "doc_id long, text string, k string").repartition(7)
    got = fingerprint.compare_with_next(df, part_bytes=part_bytes).collect()
    plain = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ordered = [(x.doc_id, x.text) for x in plain.orderBy(fingerprint._key(F.col("doc_id"), F.col("text"))).collect()]
    assert [x[0] is not None for x in ordered] == sorted(x[0] is not None for x in ordered)
    want = []
    for doc, text, edited, after in _edited(ordered):
        a, b, c = (fingerprint.Sketch(x) for x in (text, edited, after))
        near = [fingerprint._likeness(a.name, a.kept, x.name, x.kept) for x in (b, c)]
        want.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), str(a), str(b), *near))
    assert sorted((tuple(x)[:7] for x in got), key=str) == sorted(want, key=str)
    assert all(0 <= v <= 1 for x in got for v in tuple(x)[5:])


def test_no_documents_no_fingerprints(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert fingerprint.compare_with_next(df).collect() == []
    one = fingerprint.compare_with_next(spark.createDataFrame([(1, "ab cd")], df.schema)).first()
    assert (one.near_next, one.n_chars, one.edited_sha256) == (1.0, 5, hashlib.sha256(b"ab ab").hexdigest())


def test_sketch_keeps_what_lies_below_the_fraction():
    text = " ".join(f"w{i * i % 977}" for i in range(3000))
    every, some = fingerprint.Sketch(text, one_in=1), fingerprint.Sketch(text, one_in=8)
    assert every.n == len(every.kept) == some.n
    assert list(some.kept) == [h for h in every.kept if int(h) < 1 << 61]
    assert abs(len(some.kept) / every.n - 1 / 8) < 0.05


def test_containment_of_unequal_documents_and_merged_sketches(spark):
    r = random.Random(5)
    big = [f"w{r.randrange(10**6)}" for _ in range(20_000)]
    docs = [(0, " ".join(big), "x"), (1, " ".join(big[4000:4800]), "y"), (2, " ".join(big[100:500] + [f"n{i}" for i in range(400)]), "y"), (3, None, "z"), (4, "one two", "z")]
    f = fingerprint.with_fingerprints(spark.createDataFrame(docs, "doc_id long, text string, source string"))
    whole = f.where("doc_id = 0").select(F.col("fingerprint").alias("g"))
    part = dict(f.crossJoin(whole).select("doc_id", fingerprint.containment(F.col("fingerprint"), F.col("g"))).collect())
    assert part[0] == part[1] == 1 and abs(part[2] - 0.5) < 0.1 and part[3] == 0
    likeness = dict(f.crossJoin(whole).select("doc_id", fingerprint.likeness(F.col("fingerprint"), F.col("g"))).collect())
    assert likeness[0] == 1 and likeness[1] < 0.08
    merged = fingerprint.hashes(f, "source")
    want = {(s, f"{int(h):016X}") for _, x, s in docs for h in fingerprint.Sketch(x).kept}
    assert {tuple(x) for x in merged.collect()} == want
    inside = {(x.doc_id, x.source): x.part for x in fingerprint.contained_in(f, "doc_id", merged, "source").collect()}
    assert inside[1, "x"] == 1 and inside[1, "y"] == 1 and abs(inside[2, "x"] - 0.5) < 0.1
