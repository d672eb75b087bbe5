"""Results do not depend on the order of rows or on how they lie in files."""

import pytest

from lontar import plans
from tests.ordering import reordered, same

NAMES = ["corpus_digest", "token_spread", "percentiles_nearest_rank", "first_wins_dedupe", "latest_state_upsert", "recent_n_json", "stable_boost", "byte_pack", "budget_select", "greedy_diversify", "star_join", "floor_lookup", "cosine_topk", "lexical_top2", "entry_ranking", "echo_longest_run", "repair_excise", "profile_high_water", "p5_found", "p5_variants", "p7_found", "p7_counts"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    return reordered(spark, tmp_path_factory.mktemp("reordered"))


@pytest.mark.parametrize("name", NAMES)
def test_order(spark, folder, name):
    same(spark, plans.queries()[name], folder)
