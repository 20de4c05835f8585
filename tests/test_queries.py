"""Named queries against their SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect

SF = "/root/testdata/sf0.001"
NAMES = ["retention_classes", "per_record_k", "k_distribution", "tail_risk", "published_sizes", "generalize", "group_information_loss",
         "stratified_split", "folds", "materialize_release", "route_eval", "merge_exempt", "partition_leaf_bucket", "background_knowledge",
         "majority_attack", "lga_admission", "swap_table", "exchange_candidates", "ranking_quality", "paired_upper_bound"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_agrees_with_sql(spark, con, name):
    assert compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF) is None


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_saved_releases_share_their_cells(spark, monkeypatch):
    """The four saved releases of one population are made from cells that are grouped once."""
    from minim.checks import releases
    calls, cells = [], releases.R.leaf_cells
    monkeypatch.setattr(releases.R, "leaf_cells", lambda *a: calls.append(1) or cells(*a))
    out = releases.rebuild_release(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1 and out.count() > 0
