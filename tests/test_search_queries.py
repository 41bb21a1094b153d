"""What the registered queries over the hybrid search shuffle: no pairs of a query and a text."""

import pytest

import __spark_entry__
from tests_common import written

SF = "/root/testdata/sf0.01"
QUERIES = (
    *("batch_sections", "bm25_subset_topk", "in_batch_negatives", "loss_combined", "loss_marginal_likelihood", "loss_score_decay", "merge_raw_scores", "metric_hitrate_3", "metric_max_10", "metric_mrr_10", "metric_precision_10", "metric_summary"),
    *("weighted_merge", "deterministic_sample", "loss_guidance", "loss_retrieval", "loss_self_supervision", "metric_entropy", "metric_kldiv", "metric_min_10", "metric_ndcg_10", "metric_recall_10", "min_subtract"),
)


@pytest.fixture(scope="module")
def indexed(spark):
    __spark_entry__.queries()["bm25_no_match_filter"](spark, SF).collect()


@pytest.mark.parametrize("name", QUERIES)
def test_query_shuffles_no_pairs(spark, indexed, name):
    """20 queries over 1,000 texts; joined by their words they were 22,575 records and more (measured for seven of these queries)."""
    assert written(spark, lambda: __spark_entry__.queries()[name](spark, SF).collect()) < 18_000
