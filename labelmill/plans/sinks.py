"""Sinks: Parquet tables, tier and report CSVs, JSON index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill import vocab
from labelmill.plans import index, pipeline, quality


def write_products(products: DataFrame, path: str) -> None:
    """Products table, one folder per tier: tier filters prune folders."""
    products.write.mode("overwrite").partitionBy("concern_tier").parquet(path)


def write_table(rows: DataFrame, path: str, append: bool = False) -> None:
    """Append tables (matches, logs) or per-run tables (funnel, samples)."""
    rows.write.mode("append" if append else "overwrite").parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_tier_csvs(products: DataFrame, folder: str, include_excluded: bool = False) -> None:
    """One CSV folder per tier with the fixed column list; alternatives are not exported."""
    names = {t: n for t, n in vocab.TIER_CSV_NAMES.items() if include_excluded or t != "excluded"}
    for tier, name in names.items():
        rows = products.filter(F.col("concern_tier") == tier).select(*vocab.TIER_CSV_COLUMNS)
        write_csv(rows, f"{folder}/{name}")


def write_index_csvs(evaluated: DataFrame, folder: str, include_excluded: bool = False) -> None:
    names = {t: n for t, n in vocab.INDEX_CSV_NAMES.items() if include_excluded or t != "excluded"}
    for tier, name in names.items():
        write_csv(index.index_csv_rows(evaluated.filter(F.col("concern_tier") == tier)), f"{folder}/{name}")


def write_index(evaluated: DataFrame, labels: DataFrame, folder: str, order: list[str]) -> None:
    """JSON index: ``groups`` holds bounded group parts, ``metadata`` one line."""
    products = index.index_products(evaluated, order)
    index.index_parts(products, order).write.mode("overwrite").json(f"{folder}/groups")
    index.index_metadata(evaluated, labels).write.mode("overwrite").json(f"{folder}/metadata")


def write_quality_reports(
    assessed: DataFrame,
    labels: DataFrame,
    failures: DataFrame,
    products: DataFrame,
    folder: str,
    sample_size: int = vocab.SAMPLE_SIZE,
    known_positives: DataFrame | None = None,
    order: list[str] | None = None,
) -> None:
    """Report pack of one run: funnel, failures, summaries, samples, recall, validation.

    The funnel is also kept as a table that every run overwrites.
    """
    funnel = quality.funnel(assessed, labels)
    write_csv(funnel, f"{folder}/qa_funnel_summary")
    write_table(funnel, f"{folder}/tables/qa_funnel_summary")
    write_csv(failures, f"{folder}/qa_parse_failures")
    write_csv(quality.excipient_summary(products), f"{folder}/qa_excipient_summary")
    write_csv(quality.form_summary(products), f"{folder}/qa_form_summary")
    write_csv(quality.route_summary(products), f"{folder}/qa_route_summary")
    write_csv(pipeline.broad_recall(assessed), f"{folder}/broad_recall_products")
    samples = quality.samples(products, sample_size).select("bucket", *vocab.SAMPLE_COLUMNS)
    samples.write.mode("overwrite").partitionBy("bucket").option("header", True).csv(f"{folder}/qa_samples")
    if known_positives is not None:
        outcomes = quality.known_positive_outcomes(known_positives, products, order or ["spl_setid"])
        write_csv(outcomes, f"{folder}/qa_known_positives_validation")
