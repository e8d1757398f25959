"""The SQL forms against the plain versions, on the given tables."""

import brute
import cases
import pytest
from compare import connect

from fleetlag.llm import oracles


@pytest.fixture(scope="module")
def con():
    return connect(cases.SF)


def test_sql_forms(con):
    rows = con.sql("SELECT doc_id, text FROM documents").fetchall()
    items = con.sql("SELECT item_id, text FROM benchmark").fetchall()
    assert sorted(con.sql(oracles.JACCARD).fetchall()) == sorted(brute.jaccard(rows))
    assert sorted(con.sql(oracles.CONTAMINATION).fetchall()) == sorted(brute.contamination(rows, items))
    assert sorted(con.sql(oracles.SUBSTRINGS).fetchall()) == sorted(brute.word_dedup(rows))
