"""Every query of the library's own operators against its DuckDB twin."""

import pytest
from compare import DATA, differences, duck

from tidemark.plans import registry


@pytest.fixture(scope="module")
def con():
    return duck()


#: Queries that SQL cannot express, and the file whose tests hold their numbers.
ELSEWHERE = dict.fromkeys(
    "feature_tuning path_kernel kdtw_kernel global_alignment_kernel chunked_kernel_fit chunked_prediction residual_models boosted_tree_baseline pairwise_boosted_kernel grid_search_cv model_validation walk_forward_backtest vmd_filter_bank best_packet_basis stream_self_requests stream_online_modes".split(),
    "test_models.py",
) | dict.fromkeys("blocked_prediction large_chunk_fit".split(), "test_kernels.py")


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, con, name):
    assert differences(registry.QUERIES[name](spark, DATA), con, registry.SQL[name]) == ""


def test_queries_without_sql_are_held_elsewhere():
    assert set(registry.QUERIES) - set(registry.SQL) == set(ELSEWHERE)
