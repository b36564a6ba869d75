"""The near-duplicate stage against brute force: five-word shingles at Jaccard 0.8."""

import itertools
import random
from fractions import Fraction

import corpus_pipeline


def _shingles(text, n=5):
    w = text.split()
    k = min(n, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def _survivors(texts):
    """Smallest ids of the groups linked by brute force."""
    sets, root = {i: _shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(texts, 2):
        if Fraction(len(sets[a] & sets[b]), len(sets[a] | sets[b])) >= Fraction(4, 5):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {i for i in texts if top(i) == i}


def test_stage_equals_brute_force(spark):
    words = [f"w{i}" for i in range(1000)]
    copy = [f"x{i}" if i % 50 == 25 else w for i, w in enumerate(words)]
    # 896 of 1096 five-word shingles: a duplicate, although only 938 of 1058 of three words.
    texts = {1: " ".join(words), 2: " ".join(copy)}
    for f in range(12):
        r = random.Random(f)
        base = [f"f{f}v{r.randrange(300)}" for _ in range(r.randint(20, 300))]
        for i in range(8):
            edited = list(base)
            for at in r.sample(range(len(base)), min(len(base), i * len(base) // 150)):
                edited[at] = f"e{f}i{i}p{at}"
            texts[100 * (f + 1) + i] = " ".join(edited)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()}
    assert kept == _survivors(texts) and 2 not in kept
    assert 12 < len(kept) < len(texts)
