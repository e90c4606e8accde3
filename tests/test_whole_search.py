from shelfmark.checks.oracle import ORACLE


def test_clustered_catalog_search_is_the_exact_one():
    assert ORACLE["search_catalog_ivf"] == ORACLE["search_catalog"]
