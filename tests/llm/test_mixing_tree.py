"""Sources with one huge document are settled at their own last level."""

import pytest

from lodestar.llm import mixing


# Documents of the source with the huge document; the neighbour has several groups.
@pytest.mark.parametrize("n", [90, 350])
def test_small_source_beside_a_source_of_several_groups(spark, n):
    docs = [(i, "w " * 10, "a") for i in range(n)] + [(n, "w " * (10 * n // 4), "a")]
    docs += [(10_000 + i, "w " * 10, "b") for i in range(1000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.mix(df, weights=(n / 700, 1.0), share=0.5, group=100).collect()
    assert len(rows) == len(docs)
    for source in "ab":
        mine = [r for r in rows if r.source == source]
        assert 0.1 < mine[0].target / mine[0].source_size < 0.9
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 5
