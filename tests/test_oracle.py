"""Every registered query against its SQL, on the smallest data set."""

from __future__ import annotations

import pytest

from compare import contract, differences
from tellers import oracle, registry

FOLDER = "/root/testdata/sf0.001"
# Their filters keep no row of the smallest data set.
MAY_BE_EMPTY = {
    "ballot_page_by_title", "member_votes_filtered", "ballots_search", "member_search", "ballots_search_indexed", "member_search_indexed",
}


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    found = differences(spark, FOLDER, name)
    if name in MAY_BE_EMPTY and found == ["both empty"]:
        return
    assert found == []


def test_every_query_has_its_sql():
    assert set(oracle.oracle_sql()) == set(registry.queries()) <= set(contract.queries())


def test_entry_is_a_page(spark):
    assert contract.entry(spark).count() == 50
