"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from catalog import MODULES
from compare import compare, connect
from tests.conftest import SF_DIR

NAMES = [name for module in MODULES for name in module.QUERIES]


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    ok, note = compare(spark, con, name, SF_DIR)
    assert ok, note


def test_every_query_has_sql():
    assert set(NAMES) <= set(entry.queries()) and set(NAMES) <= set(entry.oracle_sql())


def test_entry_is_the_flagship(spark):
    rows = entry.entry(spark)
    assert {"spl_setid", "concern_tier", "alternative_sugar_alcohols"} <= set(rows.columns)
    assert rows.count() > 0


def test_fixed_tier_totals(spark, sf_dir):
    """Funnel totals add up and alternatives never share a key with a tiered product."""
    counts = {r["stage"]: r["count"] for r in entry.queries()["funnel"](spark, sf_dir).collect()}
    human = counts["total_records"] - counts["non_human_skipped"]
    forms = ("strong_liquid_form", "ambiguous_form", "excluded_form", "non_liquid_form")
    tiers = ("final_high", "final_moderate", "final_review", "final_excluded")
    assert human == sum(counts[f] for f in forms) == sum(counts[t] for t in tiers)
    products = entry.queries()["tiered_products"](spark, sf_dir).collect()
    assert len({p["spl_setid"] for p in products}) == len(products)
    key = lambda p: (p["product_name"].lower(), p["labeler"].lower())
    tiered = {key(p) for p in products if p["concern_tier"] != "alternative"}
    assert not tiered & {key(p) for p in products if p["concern_tier"] == "alternative"}
