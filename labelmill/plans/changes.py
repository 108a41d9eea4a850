"""Label changes: versions, their sections, listed changes, word differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill import vocab
from labelmill.functions import text
from labelmill.functions.diff import with_inline_diff
from labelmill.operators.ordered import previous_value

PAIR_TYPE = "struct<rmc_section:string,rmc_date:string>"


def recent_candidates(versions: DataFrame, start: Column, end: Column, limit: int | None = None) -> DataFrame:
    """Versions after the first that were published in a date range."""
    rows = versions.filter((F.col("version") > 1) & F.col("published_date").between(start, end))
    if limit is None:
        return rows
    return rows.orderBy(F.desc("published_date"), "setid", F.desc("version")).limit(limit)


def is_prescription(versions: DataFrame) -> DataFrame:
    return versions.filter(F.col("doc_code") == vocab.PRESCRIPTION_DOC_CODE)


def with_previous_version(versions: DataFrame) -> DataFrame:
    return previous_value(versions, "setid", "version", "previous_version")


def has_date(line: Column) -> Column:
    return F.rlike(line, F.lit(vocab.CHANGE_DATE_PATTERN))


def pair_lines(lines: Column) -> Column:
    """Pair a line with the next one when that holds a date; a pair uses up both."""
    start = F.struct(F.lit(None).cast("string").alias("held"), F.array().cast(f"array<{PAIR_TYPE}>").alias("pairs"))

    def step(state: Column, line: Column) -> Column:
        closes = state["held"].isNotNull() & has_date(line)
        pair = F.struct(state["held"].alias("rmc_section"), line.alias("rmc_date"))
        return F.struct(
            F.when(~closes, line).alias("held"),
            F.when(closes, F.concat(state["pairs"], F.array(pair))).otherwise(state["pairs"]).alias("pairs"),
        )

    return F.aggregate(F.transform(lines, text.strip), start, step, lambda s: s["pairs"])


def is_recent(date_text: Column, cutoff: Column) -> Column:
    """Any month/year in the text whose first day is not before the cutoff."""
    dates = F.regexp_extract_all(date_text, F.lit(vocab.CHANGE_DATE_PATTERN), F.lit(0))
    return F.exists(dates, lambda d: F.coalesce(F.try_to_date(d, "M/yyyy") >= cutoff, F.lit(False)))


def known_sections(parsed: DataFrame) -> DataFrame:
    """Sections with a known code: (keys..., name, lines), same-named ones joined in order."""
    keep = [c for c in parsed.columns if c != "doc"]
    pairs = [F.lit(x) for pair in vocab.SECTION_NAMES.items() for x in pair]
    table = F.create_map(*pairs)
    named = F.transform(
        "doc.sections",
        lambda s: F.struct(F.try_element_at(table, F.coalesce(s["code"], F.lit(""))).alias("name"), s["lines"].alias("lines")),
    )
    rows = parsed.select(*keep, F.filter(named, lambda s: s["name"].isNotNull() & (F.size(s["lines"]) > 0)).alias("_s"))
    # within one document: a few dozen sections at most
    grouped = F.transform(
        F.array_distinct(F.transform("_s", lambda s: s["name"])),
        lambda n: F.struct(
            n.alias("name"),
            F.flatten(F.transform(F.filter("_s", lambda s: s["name"] == n), lambda s: s["lines"])).alias("lines"),
        ),
    )
    return rows.select(*keep, F.explode(grouped).alias("g")).select(*keep, "g.name", "g.lines")


def listed_changes(sections: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., rmc_section, rmc_date) from the changes sections."""
    rows = sections.filter(F.col("name") == vocab.CHANGES_SECTION)
    return rows.select(*keys, F.explode(pair_lines(F.col("lines"))).alias("p")).select(*keys, "p.rmc_section", "p.rmc_date")


def changed_sections(candidates: DataFrame, sections: DataFrame, changes: DataFrame) -> DataFrame:
    """Listed sections of the candidates whose text differs from the previous version.

    ``candidates``: (setid, version, previous_version); ``sections``: (setid,
    version, name, section_text); ``changes``: (setid, version, rmc_section).
    All joins are on (setid, version), keys that hold a few rows each.
    """
    wanted = candidates.filter("previous_version IS NOT NULL").select("setid", "version", "previous_version")
    current = sections.filter(F.col("name") != vocab.CHANGES_SECTION).join(wanted, ["setid", "version"])
    listed = changes.select(
        F.col("setid").alias("_setid"), F.col("version").alias("_version"), "rmc_section"
    )
    on = (
        (current["setid"] == listed["_setid"])
        & (current["version"] == listed["_version"])
        & F.contains(listed["rmc_section"], current["name"])
    )
    current = current.join(listed, on, "left_semi")
    before = sections.select(
        "setid", F.col("version").alias("previous_version"), "name", F.col("section_text").alias("old_text")
    )
    rows = current.join(before, ["setid", "previous_version", "name"], "left")
    rows = rows.withColumn("old_text", F.coalesce("old_text", F.lit("")))
    return rows.filter("old_text <> section_text").select(
        "setid", "version", "previous_version", "name", "old_text", F.col("section_text").alias("new_text")
    )


def section_diffs(changed: DataFrame) -> DataFrame:
    """Inline HTML of the word differences of the changed sections."""
    # where neither text has a word there is no markup; a filter on the markup itself would work it out twice
    worded = changed.filter(F.col("old_text").rlike(r"\S") | F.col("new_text").rlike(r"\S"))
    return with_inline_diff(worded, "old_text", "new_text").drop("old_text", "new_text", "words_kept")


def change_records(candidates: DataFrame, changes: DataFrame, changed: DataFrame) -> DataFrame:
    """One row per candidate with listed changes and a previous version."""
    entries = changes.groupBy("setid", "version").agg(F.count(F.lit(1)).alias("rmc_count"))
    diffs = changed.groupBy("setid", "version").agg(F.count(F.lit(1)).alias("diff_count"))
    rows = candidates.filter("previous_version IS NOT NULL").select(
        "setid", "version", "previous_version", "published_date"
    )
    rows = rows.join(entries, ["setid", "version"]).join(diffs, ["setid", "version"], "left")
    return rows.na.fill(0, ["diff_count"])


def label_changes(
    versions: DataFrame,
    sections: DataFrame,
    changes: DataFrame,
    start: Column,
    end: Column,
    candidate_limit: int | None = None,
    shown_limit: int | None = None,
    lookback_cutoff: Column | None = None,
) -> DataFrame:
    """Report of recent label changes, newest first.

    All changes are compared and reported; ``candidate_limit`` and
    ``shown_limit`` are for pages that show a part.  ``lookback_cutoff`` keeps only labels with a listed change dated since
    then; it is off by default.
    """
    found = recent_candidates(with_previous_version(versions), start, end, candidate_limit)
    found = is_prescription(found)
    if lookback_cutoff is not None:
        recent = changes.filter(is_recent(F.col("rmc_date"), lookback_cutoff)).select("setid", "version").distinct()
        found = found.join(recent, ["setid", "version"], "left_semi")
    rows = change_records(found, changes, changed_sections(found, sections, changes))
    rows = rows.orderBy(F.desc("published_date"), "setid", F.desc("version"))
    return rows if shown_limit is None else rows.limit(shown_limit)
