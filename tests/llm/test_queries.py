"""Every registered operator query on the smallest driver tables, against SQL where there is some."""

from pathlib import Path

import pytest
from compare import connect, differences

from chronofid.llm.queries import CATALOGUE

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver tables not present")


@pytest.mark.parametrize("name", sorted(CATALOGUE.queries))
def test_query(spark, name):
    got = CATALOGUE.queries[name](spark, FOLDER).toPandas()
    if name in CATALOGUE.sql:
        assert differences(got, connect(FOLDER).execute(CATALOGUE.sql[name]).df()) is None
    elif name not in ("op8_benchmark_decontamination", "op11_phrase_collocations"):
        assert len(got) == 200


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in CATALOGUE.queries) == list(range(1, 14))
