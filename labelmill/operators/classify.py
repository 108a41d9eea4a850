"""Form, route and tier classification as columns (no shuffle, no Python)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill import vocab
from labelmill.functions.text import first_keyword


def classify_form_and_route(df: DataFrame, form: str = "dosage_form", route: str = "route") -> DataFrame:
    """Add form_class, route_class, the four keyword columns and should_process.

    Keyword hits are projected before they are used, so each list is searched
    once per row.
    """
    hits = df.withColumns({"_form": F.lower(form), "_route": F.lower(route)}).withColumns(
        {
            "_form_out": first_keyword(F.col("_form"), vocab.EXCLUDED_FORMS),
            "_form_strong": first_keyword(F.col("_form"), vocab.STRONG_FORMS),
            "_form_weak": first_keyword(F.col("_form"), vocab.AMBIGUOUS_FORMS),
            "_route_out": first_keyword(F.col("_route"), vocab.EXCLUDED_ROUTES),
            "_route_in": first_keyword(F.col("_route"), vocab.ORAL_ROUTES),
        }
    )
    out, strong, weak = F.col("_form_out"), F.col("_form_strong"), F.col("_form_weak")
    route_out, route_in = F.col("_route_out"), F.col("_route_in")
    form_class = (
        F.when(out.isNotNull(), "excluded")
        .when(strong.isNotNull(), "strong")
        .when(weak.isNotNull(), "ambiguous")
        .otherwise("non_liquid")
    )
    route_given = F.coalesce(F.col("_route"), F.lit("")) != ""
    route_class = (
        F.when(~route_given, "blank")
        .when(route_out.isNotNull() | route_in.isNull(), "excluded")
        .otherwise("oral")
    )
    classed = hits.withColumns(
        {
            "form_class": form_class,
            "route_class": route_class,
            "included_form_match": F.when(out.isNull(), F.coalesce(strong, weak)),
            "excluded_form_match": out,
            "included_route_match": F.when(route_out.isNull(), route_in),
            # an unrecognised route is its own evidence
            "excluded_route_match": F.when(
                route_given, F.coalesce(route_out, F.when(route_in.isNull(), F.col(route)))
            ),
        }
    )
    return classed.withColumn("should_process", passes_form_and_route()).drop(
        "_form", "_route", "_form_out", "_form_strong", "_form_weak", "_route_out", "_route_in"
    )


def passes_form_and_route() -> Column:
    return F.col("form_class").isin("strong", "ambiguous") & (F.col("route_class") != "excluded")


def is_human(product_type: str = "product_type") -> Column:
    """True unless a product type is given and does not mention HUMAN."""
    given = F.coalesce(F.col(product_type), F.lit(""))
    return (given == "") | F.contains(F.upper(given), F.lit("HUMAN"))


def concern_tier(matched: str = "matched") -> Column:
    found = F.size(matched) > 0
    high = F.exists(F.col(matched), lambda m: m["canonical_name"].isin(vocab.HIGH_CONCEPTS))
    return (
        F.when(~F.col("should_process") | ~found, "excluded")
        .when((F.col("form_class") == "ambiguous") & (F.col("route_class") == "blank"), "review")
        .when(high, "high")
        .otherwise("moderate")
    )


def review_reason(profile: str) -> Column:
    return F.when(F.col("concern_tier") == "review", F.lit(vocab.REVIEW_REASON[profile]))


def exclusion_reason() -> Column:
    """Audit reason of a row that did not make it; NULL for tiered rows."""
    return (
        F.when(~F.col("is_human"), "non_human_product")
        .when(F.col("form_class").isin("excluded", "non_liquid"), "excluded_form")
        .when(F.col("route_class") == "excluded", "excluded_route")
        .when(F.col("concern_tier") == "excluded", "no_sugar_alcohol_match")
    )


def decision_reasons(matched: str = "matched") -> dict[str, Column]:
    """Inclusion and exclusion evidence lists of the index profile."""

    def tag(prefix: str, c: str) -> Column:
        return F.concat(F.lit(prefix), F.col(c))

    found = F.size(matched) > 0
    names = F.array_join(F.transform(F.col(matched), lambda m: m["canonical_name"]), ",")
    included = F.array(
        tag("form:", "included_form_match"),
        tag("route:", "included_route_match"),
        F.when(found, F.concat(F.lit("sugar_alcohols:"), names)),
    )
    excluded = F.array(
        tag("form:", "excluded_form_match"),
        tag("route:", "excluded_route_match"),
        F.when(~found & (F.col("concern_tier") == "excluded"), F.lit("no_sugar_alcohol_found")),
    )
    return {
        "inclusion_reasons": F.array_compact(included),
        "exclusion_reasons": F.array_compact(excluded),
    }
