"""Event and filing queries over all rows: their SQL without its row filters."""

import pytest

from compare import connect, differences
from lodestar.plans import registry

SF = "/root/testdata/sf0.001"
# What of the SQL cuts rows, and what stands for it.
WHOLE = {
    "stream_entity_state": (" where event_id % 7 = 0", ""),
    "interval_compare": (" where event_id % 3 = 0", ""),
    "scan_parallel_arrays": ("from k where pos < 5", "from k qualify not (issuer_id % 3 = 0 and pos = count(*) over (partition by issuer_id) - 1)"),
}


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_all_rows(spark, name):
    whole = registry.oracle_sql()[name].replace(*WHOLE[name])
    assert differences(registry.queries()[name](spark, SF), connect(SF), whole) is None
