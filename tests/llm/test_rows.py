"""keep_one and apply_mix go by row: repeated rows, shared and missing ids, names that clash."""

import collections
import itertools
import random

import pytest

from lodestar.llm import mixing, ngram_join

SCHEMA = "doc_id long, text string, source string, ra string, _row int"


def _shingles(text, n):
    w = (text or "").lower().split()
    k = min(n, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def _groups(rows, num, den, n):
    sets, up = [_shingles(r[1], n) for r in rows], list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            up[top(b)] = top(a)
    out = collections.defaultdict(list)
    for i, r in enumerate(rows):
        out[top(i)].append(r)
    return list(out.values()), sets


def _random_rows(seed, n=120):
    r = random.Random(seed)
    bases = [[f"b{k}w{r.randrange(60)}" for _ in range(r.randint(8, 90))] for k in range(14)]
    rows = []
    for i in range(n):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 0, 1, 2, 6])):
            w[r.randrange(len(w))] = f"e{r.randrange(5)}"
        rows.append((r.choice([None, i // 3, i // 3, i]), r.choice([" ".join(w), " ".join(w), None, " "]) if i % 9 == 0 else " ".join(w), r.choice("ab"), "x", 1))
    return rows + [r.choice(rows) for _ in range(15)]


@pytest.mark.parametrize("seed", [1, 2])
def test_keep_one_against_brute_force(spark, seed):
    rows = _random_rows(seed)
    got = ngram_join.keep_one(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert got.columns == ["doc_id", "text", "source", "ra", "_row"]
    left = collections.Counter(tuple(r) for r in got.collect())
    groups, _ = _groups(rows, 4, 5, 5)
    assert sum(left.values()) == len(groups)
    for g in groups:
        mine = [r for r in set(g) if left[r]]
        if not _shingles(g[0][1], 5):
            assert left[g[0]] >= 1
            continue
        smallest = min((r[0] is None, r[0] or 0) for r in g)
        kept = [r for r in mine if (r[0] is None, r[0] or 0) == smallest]
        assert len(kept) == 1 and left[kept[0]] == 1 and len(mine) == 1


def test_keep_one_of_a_shared_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (None, c), (None, "alone here"), (None, "alone here")]
    got = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([(1, a), (2, b), (3, c), (None, "alone here")], key=str)


def test_one_passage_in_unrelated_short_documents(spark):
    # No bucket of the passage is left: its n-grams come last in the global order.
    r = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, passage + " " + " ".join(f"w{r.randrange(10**6)}" for _ in range(12 + i % 9))) for i in range(50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert ngram_join.jaccard_components(df).where("component_id <> doc_id").count() == 0


def test_apply_mix_gives_each_row_its_own_copies(spark):
    # Shared and missing ids, wholly equal rows, and as many of them as fill several groups.
    r = random.Random(3)
    rows = [(r.choice([None, 7, i]), " ".join(["w"] * r.randint(1, 9)) + f" x{i}", r.choice(["a", "b", None]), "r", 2) for i in range(600)]
    rows += [(5, "equal rows here", "c", "r", 2)] * 900 + [(None, None, "c", "r", 2)] * 3
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.apply_mix(df, group=100)
    assert got.columns == df.columns
    taken = collections.Counter(tuple(x) for x in got.collect())
    times = collections.Counter(rows)
    assert set(taken) <= set(times) and all(taken[x] <= 2 * times[x] for x in taken)
    words = lambda t: len((t or "").split())
    targets = {x.source: (x.target, x.source_size) for x in mixing.mix(df, group=100).select("source", "target", "source_size").distinct().collect()}
    for s, (target, size) in targets.items():
        assert sum(words(x[1]) * n for x, n in times.items() if x[2] == s) == size
        assert abs(sum(words(x[1]) * n for x, n in taken.items() if x[2] == s) - target) <= 10


def test_equal_rows_are_spread_over_groups(spark):
    rows = [(None, "one two", "a")] * 5000 + [(1, "three", "a")] * 100
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), group=400).collect()
    assert len(got) == 5100 and abs(sum(x.taken for x in got) - got[0].target) <= 2


def test_large_buckets_are_bounded_by_bands(spark, monkeypatch):
    # Every bucket is a large one, and no n-gram comes last: the same links.
    monkeypatch.setattr(ngram_join, "BUCKET", 2)
    monkeypatch.setattr(ngram_join, "LATE", 1)
    rows = [r for r in _random_rows(9, 160) if r[1]]
    got = ngram_join.keep_one(spark.createDataFrame(rows, SCHEMA).repartition(3))
    groups, sets = _groups(rows, 4, 5, 5)
    assert got.count() == sum(len(g) if not _shingles(g[0][1], 5) else 1 for g in groups)
