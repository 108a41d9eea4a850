"""Quality reports over assessed records and the products table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill import vocab
from labelmill.functions import text
from labelmill.operators.ordered import first_per_key


def tier_counts(products: DataFrame) -> DataFrame:
    return products.groupBy("concern_tier").agg(F.count(F.lit(1)).alias("product_count"))


def class_summaries(products: DataFrame) -> DataFrame:
    """Form × tier and route × tier counts from one pass over the products."""
    both = products.select(
        F.explode(
            F.array(
                F.struct(F.lit("form").alias("dimension"), F.col("form_class").alias("class")),
                F.struct(F.lit("route").alias("dimension"), F.col("route_class").alias("class")),
            )
        ).alias("d"),
        "concern_tier",
    )
    return (
        both.groupBy("d.dimension", "d.class", "concern_tier")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy("dimension", "class", "concern_tier")
    )


def form_summary(products: DataFrame) -> DataFrame:
    return _summary(products, "form_class")


def route_summary(products: DataFrame) -> DataFrame:
    return _summary(products, "route_class")


def _summary(products: DataFrame, column: str) -> DataFrame:
    return products.groupBy(column, "concern_tier").agg(F.count(F.lit(1)).alias("count")).orderBy(column, "concern_tier")


def excipient_summary(products: DataFrame) -> DataFrame:
    """Included products per concept of the pipeline vocabulary, zero counts kept."""
    listed = F.lower(F.coalesce("matched_sugar_alcohols", F.lit("")))
    included = F.col("inclusion_decision") == "included"
    names = list(vocab.PIPELINE_CONCEPTS)
    wide = products.agg(
        *[F.count_if(included & F.contains(listed, F.lit(n))).alias(n) for n in names]
    )
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(i).alias("seq"), F.lit(n).alias("canonical_name"), F.col(n).alias("product_count"))
                for i, n in enumerate(names)
            ]
        )
    )
    return wide.select(rows.alias("r")).select("r.*").orderBy("seq").drop("seq")


def _record_counters() -> dict[str, Column]:
    human = F.col("is_human")
    processed = human & F.col("should_process")

    def given(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("")) != ""

    form, route, tier = F.col("form_class"), F.col("route_class"), F.col("concern_tier")
    return {
        "total_records": F.lit(True),
        "non_human_skipped": ~human,
        "with_dosage_form": human & given("dosage_form"),
        "strong_liquid_form": human & (form == "strong"),
        "ambiguous_form": human & (form == "ambiguous"),
        "excluded_form": human & (form == "excluded"),
        "non_liquid_form": human & (form == "non_liquid"),
        "with_route": human & given("route"),
        "allowed_route": human & (route == "oral"),
        "excluded_route": human & (route == "excluded"),
        "blank_route": human & (route == "blank"),
        "with_inactive_ingredients": processed & (F.size("inactives") > 0),
        "with_sugar_alcohol_hit": processed & (F.size("matched") > 0),
        "final_high": human & (tier == "high"),
        "final_moderate": human & (tier == "moderate"),
        "final_review": human & (tier == "review"),
        "final_excluded": human & (tier == "excluded"),
    }


def funnel(assessed: DataFrame, labels: DataFrame) -> DataFrame:
    """The twenty processing counters as (stage, count) rows.

    ``labels`` has one row per label read, with a boolean ``parsed``.
    """
    record_counts = assessed.agg(*[F.count_if(c).alias(n) for n, c in _record_counters().items()])
    label_counts = labels.agg(
        F.count(F.lit(1)).alias("total_xml_files"),
        F.count_if("parsed").alias("parse_successes"),
        F.count_if(~F.col("parsed")).alias("parse_failures"),
    )
    rows = [
        frame.select(F.explode(_stage_rows(frame.columns)).alias("r")).select("r.*")
        for frame in (label_counts, record_counts)
    ]
    order = F.array_position(F.array(*[F.lit(s) for s in vocab.FUNNEL_STAGES]), F.col("stage"))
    return rows[0].unionByName(rows[1]).orderBy(order)


def _stage_rows(names: Sequence[str]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("stage"), F.col(n).alias("count")) for n in names])


def archive_funnel(assessed: DataFrame) -> DataFrame:
    """Record counters per archive and in total (source_file NULL is the total)."""
    counters = {n: F.count_if(c).alias(n) for n, c in _record_counters().items()}
    return assessed.rollup("source_file").agg(*counters.values())


def samples(products: DataFrame, size: int = vocab.SAMPLE_SIZE, seed: int = 0) -> DataFrame:
    """Up to ``size`` random rows per bucket; a row may serve several buckets.

    The draw orders rows by a seeded hash of the setid, so it repeats.
    """
    tier, decision = F.col("concern_tier"), F.col("inclusion_decision")
    buckets = F.array_compact(
        F.array(*[F.when((tier == b) | (decision == b), F.lit(b)) for b in ("included", "review", "excluded")])
    )
    rows = products.withColumn("bucket", F.explode(buckets)).withColumn(
        "_draw", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("spl_setid")))
    )
    return first_per_key(rows, ["bucket"], [F.col("_draw"), F.col("spl_setid")], size).drop("_draw")


def read_known_positives(spark, path: str) -> DataFrame:
    names = ["expected_product_name", "expected_setid", "expected_excipient", "expected_decision", "notes"]
    rows = spark.read.csv(path, header=True, schema=", ".join(f"{n} string" for n in names))
    return rows.select(*[text.strip(F.coalesce(n, F.lit(""))).alias(n) for n in names])


def known_positive_outcomes(expected: DataFrame, products: DataFrame, order: Sequence[str]) -> DataFrame:
    """PASS / MISSING / FAIL_EXCIPIENT / FAIL_TIER per expected row.

    Rows with a setid are looked up by it, the others by normalised name; of
    several products the first in ``order`` counts.
    """
    facts = F.struct(
        *order, "spl_setid", "concern_tier", "inclusion_decision", "matched_sugar_alcohols"
    )
    # one row per key before the join: minimum by write order, combined map-side
    by_setid = products.groupBy("spl_setid").agg(F.min(facts).alias("by_setid"))
    by_name = products.groupBy(
        text.normalize_text(F.coalesce("product_name", F.lit(""))).alias("_name")
    ).agg(F.min(facts).alias("by_name"))
    has_setid = F.col("expected_setid") != ""
    # each kind is joined on its own key, so that no blank key gathers the other kind
    coded = expected.filter(has_setid)
    coded = coded.join(by_setid, F.col("expected_setid") == F.col("spl_setid"), "left").drop("spl_setid")
    named = expected.filter(~has_setid).withColumn("_name", text.normalize_text(F.col("expected_product_name")))
    named = named.join(by_name, "_name", "left").drop("_name")
    rows = coded.withColumnRenamed("by_setid", "found").unionByName(named.withColumnRenamed("by_name", "found"))
    listed = F.coalesce("found.matched_sugar_alcohols", F.lit(""))
    wanted = text.normalize_text(F.col("expected_excipient"))
    members = F.transform(text.split_list(listed), text.normalize_text)
    excipient_ok = (
        (F.col("expected_excipient") == "")
        | F.array_contains(members, wanted)
        | F.contains(text.normalize_text(listed), wanted)
    )
    decision = text.normalize_text(F.col("expected_decision"))
    decision_ok = (F.col("expected_decision") == "") | decision.isin(
        text.normalize_text(F.col("found.inclusion_decision")), text.normalize_text(F.col("found.concern_tier"))
    )
    outcome = (
        F.when(F.col("found.spl_setid").isNull(), "MISSING")
        .when(~excipient_ok, "FAIL_EXCIPIENT")
        .when(~decision_ok, "FAIL_TIER")
        .otherwise("PASS")
    )
    return rows.select(
        "expected_product_name",
        "expected_setid",
        "expected_excipient",
        "expected_decision",
        "notes",
        outcome.alias("outcome"),
        F.coalesce("found.spl_setid", F.lit("")).alias("found_setid"),
        F.coalesce("found.inclusion_decision", F.lit("")).alias("found_decision"),
        listed.alias("found_excipients"),
    )


def outcome_totals(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(
        F.count_if(F.col("outcome") == "PASS").alias("passes"), F.count(F.lit(1)).alias("total")
    )


def check_cases(got: DataFrame, expected: str, actual: str) -> DataFrame:
    """PASS/FAIL per case row of a classifier or matcher check."""
    ok = F.col(expected).eqNullSafe(F.col(actual))
    return got.withColumn("result", F.when(ok, "PASS").otherwise("FAIL"))


def all_passed(checked: DataFrame) -> DataFrame:
    return checked.agg(F.bool_and(F.col("result") == "PASS").alias("all_passed"))
