"""Results do not depend on the order of rows or on how they lie in files."""

import pytest

from lontar.llm import queries
from tests.ordering import reordered, same


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    return reordered(spark, tmp_path_factory.mktemp("reordered"))


@pytest.mark.parametrize("name", ["p1_found", "p2_restored", "p3_bonds", "p4_stretches", "p6_pieces", "p8_containers", "p9_items", "p10_scores"])
def test_order(spark, folder, name):
    same(spark, queries.queries()[name], folder)
