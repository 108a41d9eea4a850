"""Batch job: product records to tiered products, matches, alternatives.

Input is a frame of product records (see ``schemas.RECORD``), one row per
product subject of a label, in the order given by the ``write_order`` columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.functions import text
from labelmill.operators import classify, match
from labelmill.operators.joins import salted_join
from labelmill.operators.ordered import first_per_key, last_per_key
from labelmill.session import stage

TIERED = ["high", "moderate", "review"]
#: Product columns that the choice of products and alternatives reads.
PROMOTION = [
    "spl_setid", "product_name", "labeler", "form_class", "route_class", "active_ingredients_unii", "concern_tier",
    "matched_sugar_alcohols",
]


def assess(records: DataFrame, profile: str = "pipeline") -> DataFrame:
    """Add is_human, form/route classes, matches, tier and reasons.

    Ingredients are searched only where form and route pass (``pipeline``), or
    for every row (``app``, which reports matches of excluded rows too).
    """
    out = classify.classify_form_and_route(records).withColumn("is_human", classify.is_human())
    found = match.match_concepts(F.col("inactives"), profile)
    if profile == "pipeline":
        none = F.array().cast(f"array<{match.MATCH_TYPE}>")
        found = F.when(F.col("should_process") & F.col("is_human"), found).otherwise(none)
    out = out.withColumn("matched", found).withColumn("concern_tier", classify.concern_tier())
    return out.withColumn("review_reason", classify.review_reason(profile)).withColumn(
        "exclusion_reason", classify.exclusion_reason()
    )


def join_values(items: str, field: str, skip_blank: bool) -> Column:
    """``; `` list of one field; blanks are skipped or kept as empty places."""
    values = F.transform(F.col(items), lambda i: F.coalesce(i[field], F.lit("")))
    if skip_blank:
        values = F.filter(values, lambda v: v != "")
    return F.array_join(values, "; ")


def product_rows(assessed: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Stored product columns of assessed human records."""
    decision = F.when(F.col("concern_tier") == "excluded", "excluded").otherwise("included")
    return assessed.filter("is_human").select(
        F.col("setid").alias("spl_setid"),
        "product_name",
        "labeler",
        "dosage_form",
        text.normalize_text(F.coalesce("dosage_form", F.lit(""))).alias("normalized_form"),
        "form_class",
        "route",
        text.normalize_text(F.coalesce("route", F.lit(""))).alias("normalized_route"),
        "route_class",
        F.array_join("ndcs", "; ").alias("ndcs"),
        text.blank_to_null(join_values("actives", "name", False)).alias("active_ingredients_raw"),
        text.blank_to_null(join_values("actives", "strength", True)).alias("active_strength"),
        text.blank_to_null(join_values("actives", "unii", True)).alias("active_ingredients_unii"),
        "concern_tier",
        decision.alias("inclusion_decision"),
        "review_reason",
        "included_form_match",
        "excluded_form_match",
        "included_route_match",
        "excluded_route_match",
        text.blank_to_null(join_values("inactives", "raw_name", False)).alias("inactive_ingredients_raw"),
        join_values("inactives", "unii", False).alias("inactive_ingredients_unii"),
        join_values("matched", "canonical_name", False).alias("matched_sugar_alcohols"),
        join_values("matched", "raw_name", False).alias("matched_sugar_alcohol_terms"),
        join_values("matched", "unii", False).alias("matched_sugar_alcohol_uniis"),
        "source_file",
        *extra,
    )


def tiered_rows(assessed: DataFrame, extra: Sequence[str] = (), include_excluded: bool = False) -> DataFrame:
    """Rows to store; excluded ones only for debugging."""
    rows = product_rows(assessed, extra)
    return rows if include_excluded else rows.filter("concern_tier <> 'excluded'")


def upsert_products(rows: DataFrame, order: Sequence[str], existing: DataFrame | None = None) -> DataFrame:
    """Last write per setid wins; stored rows lose against new ones."""
    new = rows.withColumn("_run", F.lit(1))
    if existing is not None:
        new = new.unionByName(existing.withColumn("_run", F.lit(0)), allowMissingColumns=True)
    return last_per_key(new, ["spl_setid"], ["_run", *order]).drop("_run")


def matched_excipients(assessed: DataFrame, distinct: bool = False) -> DataFrame:
    """One row per stored match of tiered records (reruns append, as stored)."""
    rows = assessed.filter("is_human AND concern_tier <> 'excluded'").select(
        F.col("setid").alias("spl_setid"), F.explode("matched").alias("m")
    )
    rows = rows.select(
        "spl_setid", "m.raw_name", "m.normalized_name", "m.canonical_name", "m.category", "m.unii"
    )
    return rows.distinct() if distinct else rows


def liquid_candidates(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """First unmatched liquid row per setid that names an active UNII.

    ``rows`` are product rows, excluded ones included.
    """
    liquid = classify.passes_form_and_route() & (F.col("concern_tier") == "excluded")
    rows = rows.filter(liquid & F.col("active_ingredients_unii").isNotNull())
    return first_per_key(rows, ["spl_setid"], [F.col(c) for c in order])


def _name_key(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "_name": F.lower(F.coalesce("product_name", F.lit(""))),
            "_labeler": F.lower(F.coalesce("labeler", F.lit(""))),
        }
    )


def alternatives(products: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates that share an active UNII with a tiered product.

    Candidates whose (name, labeler) is a tiered product are left out.  The
    UNII side is reduced to one row per UNII before the join; candidate rows
    of a common substance are spread by the salted join.
    """
    tiered = products.filter(F.col("concern_tier").isin(TIERED))
    avoided = (
        tiered.select(
            F.explode(text.split_list(F.col("active_ingredients_unii"))).alias("unii"),
            text.split_list(F.col("matched_sugar_alcohols")).alias("names"),
        )
        .select("unii", F.explode("names").alias("name"))
        .groupBy("unii")
        .agg(F.collect_set("name").alias("names"))
    )
    taken = _name_key(tiered).select("_name", "_labeler").distinct()
    free = _name_key(candidates).join(taken, ["_name", "_labeler"], "left_anti").drop("_name", "_labeler")
    shared = salted_join(
        free.select("spl_setid", F.explode(text.split_list(F.col("active_ingredients_unii"))).alias("unii")),
        avoided,
        "unii",
        ["spl_setid"],
    )
    # a candidate has a handful of UNIIs and there are at most eight names
    promoted = shared.groupBy("spl_setid").agg(
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("names")))), "; ").alias(
            "alternative_sugar_alcohols"
        )
    )
    rows = free.join(promoted, "spl_setid")
    blank = F.lit("")
    return rows.withColumns(
        {
            "concern_tier": F.lit("alternative"),
            "inclusion_decision": F.lit("included"),
            "matched_sugar_alcohols": blank,
            "matched_sugar_alcohol_terms": blank,
            "matched_sugar_alcohol_uniis": blank,
            "included_form_match": F.lit(None).cast("string"),
            "excluded_form_match": F.lit(None).cast("string"),
            "included_route_match": F.lit(None).cast("string"),
            "excluded_route_match": F.lit(None).cast("string"),
        }
    )


def with_alternatives(products: DataFrame, candidates: DataFrame) -> DataFrame:
    """Products plus promoted alternatives; a stored setid is never replaced."""
    promoted = alternatives(products, candidates)
    new = promoted.join(products.select("spl_setid"), "spl_setid", "left_anti")
    return products.unionByName(new, allowMissingColumns=True)


def tier_products(
    records: DataFrame,
    order: Sequence[str] = ("subject_seq",),
    include_excluded: bool = False,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Whole job on product records: tiered products and their alternatives.

    The assessed rows are staged by tier once: tiered products, candidates and
    the UNII table read their own columns and tiers from there.  Where only
    some ``columns`` of the result are wanted, the others are neither made nor
    staged, and the chosen products and candidates are staged too.
    """
    rows = product_rows(assess(records), order)
    if columns is None:
        return _tiered(stage(rows, "assessed", ["concern_tier"]), order, include_excluded)
    needed = {*PROMOTION, *columns, *order}
    rows = stage(rows.select(*[c for c in rows.columns if c in needed]), "assessed", ["concern_tier"])
    products = stage(upsert_products(_included(rows, include_excluded), order), "products")
    candidates = stage(liquid_candidates(rows, order), "candidates")
    return with_alternatives(products, candidates).select(*columns)


def tier_assessed(assessed: DataFrame, order: Sequence[str] = ("subject_seq",), include_excluded: bool = False) -> DataFrame:
    """The same for records that are assessed and staged already: their product columns are made where they are read."""
    return _tiered(product_rows(assessed, order), order, include_excluded)


def _included(rows: DataFrame, include_excluded: bool) -> DataFrame:
    return rows if include_excluded else rows.filter("concern_tier <> 'excluded'")


def _tiered(rows: DataFrame, order: Sequence[str], include_excluded: bool) -> DataFrame:
    products = upsert_products(_included(rows, include_excluded), order)
    return with_alternatives(products, liquid_candidates(rows, order)).drop(*order)


def broad_recall(assessed: DataFrame) -> DataFrame:
    """Every human record that passes form and route, matched or not."""
    rows = product_rows(assessed.filter("should_process"))
    return rows.select(
        "spl_setid",
        "product_name",
        F.coalesce("labeler", F.lit("")).alias("labeler"),
        F.coalesce("dosage_form", F.lit("")).alias("dosage_form"),
        F.coalesce("route", F.lit("")).alias("route"),
        "form_class",
        "route_class",
        "matched_sugar_alcohols",
        "matched_sugar_alcohol_terms",
        "concern_tier",
        F.when(F.col("concern_tier") != "excluded", "True").otherwise("False").alias("in_strict_output"),
        "source_file",
    )


def excluded_audit(assessed: DataFrame) -> DataFrame:
    """One audit row per record that did not make a tier, with the reason."""
    human = F.col("is_human")
    return assessed.filter("exclusion_reason IS NOT NULL").select(
        F.col("setid").alias("spl_setid"),
        "product_name",
        "dosage_form",
        "route",
        F.when(human, F.col("form_class")).otherwise("").alias("form_class"),
        F.when(human, F.col("route_class")).otherwise("").alias("route_class"),
        "exclusion_reason",
        F.lit(None).cast("string").alias("review_reason"),
        join_values("matched", "raw_name", False).alias("matched_sugar_alcohol_terms"),
        "source_file",
    )


def pending_archives(archives: DataFrame, log: DataFrame) -> DataFrame:
    """Archives without a success entry in the processing log."""
    done = log.filter("status = 'success'").select("source_file").distinct()
    return archives.join(done, "source_file", "left_anti")


def archive_log(assessed: DataFrame, failures: DataFrame) -> DataFrame:
    """Per-archive counts and the success message of the processing log.

    ``failures`` has one row per label that gave no records (source_file).
    """
    human = F.col("is_human")
    counts = assessed.groupBy("source_file").agg(
        *[F.count_if(human & (F.col("concern_tier") == t)).alias(t) for t in ("high", "moderate", "review", "excluded")],
        F.count_distinct("setid").alias("spls"),
    )
    errors = failures.groupBy("source_file").agg(F.count(F.lit(1)).alias("parse_errors"))
    out = counts.join(errors, "source_file", "full_outer").na.fill(0)
    names = ["high", "moderate", "review", "excluded", "spls", "parse_errors"]
    message = F.concat_ws(", ", *[F.concat(F.lit(f"{n}="), F.col(n).cast("string")) for n in names])
    return out.select("source_file", *names, message.alias("message"))
