"""Screener queries over the tiered products, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import base
from catalog.tiering import products
from labelmill.functions import text
from labelmill.plans import screener
from labelmill.sources import derived

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


_active = base.title_case("trim(split_part(active_ingredients_raw, ';', 1))")
GROUPED = f"""
grouped AS (
  SELECT *, coalesce({_active}, 'Unknown') AS active_ingredient, lower(coalesce({_active}, 'Unknown')) AS group_key,
    string_split(matched_sugar_alcohols, '; ') AS listed FROM products
)"""
TO_GROUPED = [*base.TO_PRODUCTS, GROUPED]
_rows = """SELECT group_key, active_ingredient, product_name, spl_setid, labeler, dosage_form, route, active_strength AS strength,
  matched_sugar_alcohols AS sugar_alcohols, array_to_string(list_filter(string_split(matched_sugar_alcohol_uniis, '; '), lambda u: u <> ''), '; ') AS sugar_alcohol_uniis,
  concern_tier, ndcs FROM grouped WHERE concern_tier <> 'alternative'"""


def _flat(rows):
    lists = ("sugar_alcohols", "sugar_alcohol_uniis", "ndcs")
    return rows.drop("active_ingredients_raw").withColumns({c: F.array_join(c, "; ") for c in lists})


@query("screener_all", base.with_ctes(TO_GROUPED, _rows))
def screener_all(spark, sf):
    return _flat(screener.group_products(products(spark, sf)))


@query("screener_multiple", base.with_ctes(TO_GROUPED, _rows + " AND len(listed) > 1"))
def screener_multiple(spark, sf):
    return _flat(screener.group_products(products(spark, sf), "multiple"))


@query("screener_sorbitol", base.with_ctes(TO_GROUPED, _rows + " AND list_contains(listed, 'sorbitol')"))
def screener_sorbitol(spark, sf):
    return _flat(screener.group_products(products(spark, sf), "sorbitol"))


@query(
    "screener_alternatives",
    base.with_ctes(
        TO_GROUPED,
        """SELECT group_key, product_name, spl_setid, labeler, ndcs, alternative_sugar_alcohols AS avoids_sugar_alcohols
           FROM grouped WHERE concern_tier = 'alternative' AND group_key IN (
             SELECT group_key FROM grouped WHERE concern_tier <> 'alternative' AND list_contains(listed, 'xylitol'))""",
    ),
)
def screener_alternatives(spark, sf):
    rows = screener.group_alternatives(products(spark, sf), "xylitol")
    return rows.select(
        "group_key", "product_name", "spl_setid", "labeler", F.array_join("ndcs", "; ").alias("ndcs"),
        F.array_join("avoids_sugar_alcohols", "; ").alias("avoids_sugar_alcohols"),
    )


@query(
    "screener_groups",
    base.with_ctes(
        TO_GROUPED,
        """SELECT group_key, min(active_ingredient) FILTER (concern_tier <> 'alternative') AS ingredient_name,
             count(*) FILTER (concern_tier <> 'alternative') AS product_count, count(*) FILTER (concern_tier = 'high') AS high_count,
             count(*) FILTER (concern_tier = 'moderate') AS moderate_count, count(*) FILTER (concern_tier = 'alternative') AS alternative_count
           FROM grouped GROUP BY group_key HAVING count(*) FILTER (concern_tier <> 'alternative') > 0""",
    ),
)
def screener_groups(spark, sf):
    return screener.group_totals(products(spark, sf))


@query(
    "concept_counts",
    base.with_ctes(
        TO_GROUPED,
        """SELECT sugar_alcohol, CAST(count(*) AS BIGINT) AS product_count FROM (SELECT unnest(listed) AS sugar_alcohol FROM grouped) x
           WHERE sugar_alcohol <> '' GROUP BY sugar_alcohol""",
    ),
)
def concept_counts(spark, sf):
    return screener.concept_counts(products(spark, sf))


@query("multiple_count", base.with_ctes(TO_GROUPED, "SELECT count(*) AS multiple FROM grouped WHERE len(listed) > 1"))
def multiple_count(spark, sf):
    return screener.multiple_count(products(spark, sf))


@query(
    "screener_stats",
    base.with_ctes(
        TO_GROUPED,
        """SELECT count(*) FILTER (concern_tier = 'high') AS total_high, count(*) FILTER (concern_tier = 'moderate') AS total_moderate,
             count(*) FILTER (concern_tier = 'review') AS total_review, max(ndcs) AS last_processed FROM grouped""",
    ),
)
def screener_stats(spark, sf):
    """Stats with the NDC text standing in for the processing time."""
    return screener.stats(products(spark, sf), "ndcs")


@query(
    "product_by_setid",
    base.with_ctes(
        TO_GROUPED,
        "SELECT spl_setid, product_name, labeler, concern_tier, ndcs FROM grouped WHERE spl_setid = 'set-2-0-1'",
    ),
)
def product_by_setid(spark, sf):
    return screener.product_by_setid(products(spark, sf), "set-2-0-1").select(
        "spl_setid", "product_name", "labeler", "concern_tier", "ndcs"
    )


@query(
    "ingredient_positions",
    base.with_ctes(
        [*TO_GROUPED, """
        aligned AS (
          SELECT spl_setid, 'active' AS ing_role, string_split(active_ingredients_raw, '; ') AS names,
            string_split(active_ingredients_unii, '; ') AS uniis, string_split(active_strength, '; ') AS strengths FROM products
          UNION ALL SELECT spl_setid, 'inactive', string_split(inactive_ingredients_raw, '; '), string_split(inactive_ingredients_unii, '; '), NULL
          FROM products),
        placed AS (SELECT *, unnest(names) AS n, generate_subscripts(names, 1) AS pos FROM aligned)"""],
        f"""SELECT spl_setid, ing_role, CAST(pos AS BIGINT) AS pos, {base.title_case('n')} AS display_name,
              coalesce(nullif(uniis[pos], ''), '—') AS unii, coalesce(nullif(strengths[pos], ''), '—') AS strength FROM placed""",
    ),
)
def ingredient_positions(spark, sf):
    rows = screener.ingredient_positions(products(spark, sf))
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "form_choices",
    base.with_ctes([base.LINES, base.RECORDS], "SELECT DISTINCT dosage_form FROM records WHERE dosage_form <> ''"),
)
def form_choices(spark, sf):
    return screener.form_choices(derived.label_records(spark, sf))


@query(
    "page_filter",
    base.with_ctes(
        TO_GROUPED,
        _rows + """ AND (contains(group_key, 'red') OR contains(lower(product_name), 'red')) AND concern_tier IN ('high', 'review')
          AND (list_contains(listed, 'mannitol') OR list_contains(listed, 'xylitol'))""",
    ),
)
def page_filter(spark, sf):
    rows = screener.group_products(products(spark, sf))
    chosen = {"concern_tier": ["high", "review"], "sugar_alcohols": ["mannitol", "xylitol"]}
    return _flat(screener.page_filter(rows, "Red", chosen))


@query(
    "page_sort",
    base.with_ctes(
        TO_GROUPED,
        """SELECT spl_setid, strength, CASE WHEN v IS NULL THEN 'inf'::DOUBLE ELSE v END AS first_key,
             array_to_string(list_transform(regexp_extract_all(lower(coalesce(strength, '')), '[0-9]+|[^0-9]+'), lambda r:
               CASE WHEN regexp_full_match(r, '[0-9]+') THEN lpad(CAST(length(CAST(CAST(r AS BIGINT) AS VARCHAR)) AS VARCHAR), 6, '0') || CAST(CAST(r AS BIGINT) AS VARCHAR) ELSE r END), '')
               AS second_key
           FROM (SELECT spl_setid, active_strength AS strength, CAST(nullif(regexp_extract(active_strength, '[0-9]+'), '') AS DOUBLE) AS v
             FROM grouped WHERE concern_tier <> 'alternative') s""",
    ),
)
def page_sort(spark, sf):
    """Strongest first, shown with the sort keys."""
    rows = screener.page_sort(screener.group_products(products(spark, sf)), "strength", descending=True)
    shown = F.coalesce("strength", F.lit(""))
    return rows.select(
        "spl_setid",
        "strength",
        text.strength_sort_value(shown).alias("first_key"),
        text.numeric_aware(shown).alias("second_key"),
    )
