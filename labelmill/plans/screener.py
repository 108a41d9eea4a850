"""Screener: filtered product groups, their alternatives, counts and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.functions import text
from labelmill.operators.joins import salted_join

OPTIONAL_COLUMNS = [
    "active_strength",
    "active_ingredients_unii",
    "inactive_ingredients_unii",
    "matched_sugar_alcohol_uniis",
    "alternative_sugar_alcohols",
]


def read_products(spark, path: str) -> DataFrame:
    """Stored products; columns an older table lacks come back as NULL."""
    rows = spark.read.option("mergeSchema", "true").parquet(path)
    missing = [c for c in OPTIONAL_COLUMNS if c not in rows.columns]
    return rows.withColumns({c: F.lit(None).cast("string") for c in missing}) if missing else rows


def concept_filter(sugar_alcohol: str | None) -> Column:
    """All, ``multiple`` (more than one listed) or exactly one listed concept."""
    listed = F.col("matched_sugar_alcohols")
    if sugar_alcohol in (None, "", "all"):
        return F.lit(True)
    if sugar_alcohol == "multiple":
        return F.contains(listed, F.lit("; "))
    return F.array_contains(F.split(F.lower(listed), "; "), sugar_alcohol.lower())


def included(products: DataFrame, sugar_alcohol: str | None = None) -> DataFrame:
    keep = (F.col("inclusion_decision") == "included") & (F.col("concern_tier") != "alternative")
    return products.filter(keep & concept_filter(sugar_alcohol))


def _grouped(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("active_ingredient", text.primary_active(F.col("active_ingredients_raw")))
    return rows.withColumn("group_key", F.lower("active_ingredient"))


def group_products(products: DataFrame, sugar_alcohol: str | None = None) -> DataFrame:
    """Flat screener rows, sorted by group, ingredient text, name and setid."""
    rows = _grouped(included(products, sugar_alcohol))
    return rows.select(
        "group_key",
        "active_ingredient",
        F.coalesce("product_name", F.lit("Unknown")).alias("product_name"),
        "spl_setid",
        "labeler",
        "dosage_form",
        "route",
        "active_ingredients_raw",
        F.col("active_strength").alias("strength"),
        text.split_list(F.col("matched_sugar_alcohols")).alias("sugar_alcohols"),
        text.split_list(F.col("matched_sugar_alcohol_uniis")).alias("sugar_alcohol_uniis"),
        "concern_tier",
        text.split_list(F.col("ndcs")).alias("ndcs"),
    ).orderBy("group_key", F.asc_nulls_first("active_ingredients_raw"), F.asc_nulls_first("product_name"), "spl_setid")


def group_alternatives(products: DataFrame, sugar_alcohol: str | None = None) -> DataFrame:
    """Alternatives of groups that hold filtered products; the filter does not apply to them."""
    keys = _grouped(included(products, sugar_alcohol)).select("group_key").distinct()
    rows = _grouped(products.filter("concern_tier = 'alternative'")).select(
        "group_key",
        "active_ingredient",
        F.coalesce("product_name", F.lit("Unknown")).alias("product_name"),
        "spl_setid",
        "labeler",
        "dosage_form",
        "route",
        "active_ingredients_raw",
        F.col("active_strength").alias("strength"),
        text.split_list(F.col("ndcs")).alias("ndcs"),
        text.split_list(F.col("alternative_sugar_alcohols")).alias("avoids_sugar_alcohols"),
    )
    return salted_join(rows, keys, "group_key", ["spl_setid"])


def group_totals(products: DataFrame, sugar_alcohol: str | None = None) -> DataFrame:
    """One row per group: label, product counts by tier, number of alternatives.

    Both sides are counted per group before they meet, so no group is gathered.
    """
    order = F.struct(F.coalesce("active_ingredients_raw", F.lit("")), F.coalesce("product_name", F.lit("")), "spl_setid")
    groups = _grouped(included(products, sugar_alcohol)).groupBy("group_key").agg(
        F.min_by("active_ingredient", order).alias("ingredient_name"),
        F.count(F.lit(1)).alias("product_count"),
        F.count_if(F.col("concern_tier") == "high").alias("high_count"),
        F.count_if(F.col("concern_tier") == "moderate").alias("moderate_count"),
    )
    alternatives = (
        _grouped(products.filter("concern_tier = 'alternative'"))
        .groupBy("group_key")
        .agg(F.count(F.lit(1)).alias("alternative_count"))
    )
    return groups.join(alternatives, "group_key", "left").na.fill(0, ["alternative_count"]).orderBy("group_key")


def concept_counts(products: DataFrame) -> DataFrame:
    """Included products per listed concept, most frequent first."""
    listed = products.filter("inclusion_decision = 'included'").select(
        F.explode(text.split_list(F.col("matched_sugar_alcohols"))).alias("sugar_alcohol")
    )
    counts = listed.groupBy("sugar_alcohol").agg(F.count(F.lit(1)).alias("product_count"))
    return counts.orderBy(F.desc("product_count"), "sugar_alcohol")


def multiple_count(products: DataFrame) -> DataFrame:
    several = F.size(text.split_list(F.col("matched_sugar_alcohols"))) > 1
    return products.agg(
        F.count_if((F.col("inclusion_decision") == "included") & several).alias("multiple")
    )


def stats(products: DataFrame, processed_at: str = "processed_at") -> DataFrame:
    """Included counts of the three tiers and the latest processing time of any row."""
    shown = F.col("inclusion_decision") == "included"
    return products.agg(
        *[
            F.count_if(shown & (F.col("concern_tier") == t)).alias(f"total_{t}")
            for t in ("high", "moderate", "review")
        ],
        F.max(processed_at).alias("last_processed"),
    )


def product_by_setid(products: DataFrame, setid: str) -> DataFrame:
    """Included product of one setid (point lookup; the filter reaches the scan)."""
    return (
        products.filter((F.col("spl_setid") == setid) & (F.col("inclusion_decision") == "included"))
        .withColumn("product_name", F.coalesce("product_name", F.lit("Unknown")))
        .limit(1)
    )


def ingredient_positions(products: DataFrame) -> DataFrame:
    """Ingredient lists aligned by position, gaps shown as a dash."""
    dash = F.lit("—")

    def aligned(role: str, names: str, strengths: Column, uniis: str) -> DataFrame:
        rows = products.select(
            "spl_setid",
            F.posexplode(F.split(names, "; ")).alias("at", "name"),
            F.split(strengths, "; ").alias("strengths"),
            F.split(uniis, "; ").alias("uniis"),
        )

        def place(c: str) -> Column:
            return F.coalesce(text.blank_to_null(F.get(c, F.col("at"))), dash)

        return rows.select(
            "spl_setid",
            F.lit(role).alias("ing_role"),
            (F.col("at") + 1).alias("pos"),
            text.title_case(F.col("name")).alias("display_name"),
            place("uniis").alias("unii"),
            place("strengths").alias("strength"),
        )

    no_strength = F.lit(None).cast("string")
    active = aligned("active", "active_ingredients_raw", F.col("active_strength"), "active_ingredients_unii")
    inactive = aligned("inactive", "inactive_ingredients_raw", no_strength, "inactive_ingredients_unii")
    return active.unionByName(inactive)


# --- result page rules ---------------------------------------------------------


def form_choices(rows: DataFrame) -> DataFrame:
    """Distinct non-blank dosage forms, sorted."""
    forms = rows.select(F.trim("dosage_form").alias("dosage_form")).filter("dosage_form <> ''")
    return forms.distinct().orderBy("dosage_form")


def page_filter(rows: DataFrame, search: str = "", chosen: dict[str, list[str]] | None = None) -> DataFrame:
    """Search text in group or product name and per-column multi-select.

    A row stays when, for every column with chosen values, its value (or one
    element of a list column) is among them.
    """
    needle = search.strip().lower()
    if needle:
        rows = rows.filter(
            F.contains(F.lower("active_ingredient"), F.lit(needle)) | F.contains(F.lower("product_name"), F.lit(needle))
        )
    lists = {f.name for f in rows.schema.fields if f.dataType.typeName() == "array"}
    for column, values in (chosen or {}).items():
        if values and column in lists:
            rows = rows.filter(F.arrays_overlap(F.col(column), F.array(*[F.lit(v) for v in values])))
        elif values:
            rows = rows.filter(F.trim(column).isin(values))
    return rows


def page_sort(rows: DataFrame, column: str, descending: bool = False, tie: str = "spl_setid") -> DataFrame:
    """Numeric-aware, case-insensitive order; strengths by their first number or ratio."""
    value = F.coalesce(F.col(column), F.lit(""))
    keys = [text.numeric_aware(value)]
    if column == "strength":
        keys.insert(0, text.strength_sort_value(value))
    return rows.orderBy(*[k.desc() if descending else k.asc() for k in keys], F.col(tie))
