"""Ingredient matching: sugar alcohol concepts and user filter terms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill import vocab
from labelmill.functions import ingredients, text

MATCH_TYPE = (
    "struct<raw_name:string,normalized_name:string,canonical_name:string,category:string,"
    "unii:string,matched_term:string>"
)


def _category(concept: str) -> str:
    return "high" if concept in vocab.HIGH_CONCEPTS else "moderate"


def _core_aliases(aliases: Sequence[str]) -> list[str]:
    """Aliases that contain no other alias; enough to decide whether any alias hits."""
    return [a for a in aliases if not any(b != a and b in a for b in aliases)]


def _concept_table(concepts: dict[str, list[str]]) -> Column:
    """Constant array of (name, category, all aliases, deciding aliases)."""

    def array(values: Sequence[str]) -> str:
        return "array(" + ", ".join(f"'{v}'" for v in values) + ")"

    rows = ", ".join(
        f"named_struct('name', '{c}', 'category', '{_category(c)}', 'aliases', {array(a)}, 'core', {array(_core_aliases(a))})"
        for c, a in concepts.items()
    )
    return F.expr(f"array({rows})")


def match_concepts(inactives: Column, profile: str = "pipeline") -> Column:
    """At most one match per concept, in vocabulary order: the first ingredient hit.

    ``pipeline`` searches normalised text for six concepts, ``app`` searches
    lower-cased text for eight and also reports the first alias hit.
    Shuffle-free: works inside the record's own ingredient array against a
    constant concept table.
    """
    table = _concept_table(vocab.PIPELINE_CONCEPTS if profile == "pipeline" else vocab.APP_CONCEPTS)
    searchable = text.normalize_text if profile == "pipeline" else F.lower

    def with_text(i: Column) -> Column:
        return F.struct(i.alias("ing"), searchable(i["raw_name"]).alias("t"))

    def hits(concept: Column, items: Column) -> Column:
        found = F.filter(items, lambda i: F.exists(concept["core"], lambda a: F.contains(i["t"], a)))
        return F.transform(
            F.slice(found, 1, 1),
            lambda i: F.struct(
                i["ing"]["raw_name"].alias("raw_name"),
                i["ing"]["normalized_name"].alias("normalized_name"),
                concept["name"].alias("canonical_name"),
                concept["category"].alias("category"),
                i["ing"]["unii"].alias("unii"),
                text.first_keyword(i["t"], concept["aliases"]).alias("matched_term"),
            ),
        )

    matched = text.bind(
        F.transform(inactives, with_text), lambda items: F.flatten(F.transform(table, lambda c: hits(c, items)))
    )
    return F.coalesce(matched, F.array()).cast(f"array<{MATCH_TYPE}>")


def match_alias_table(ingredient_rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Set form for user-supplied alias tables: flat ingredient rows × alias rows.

    ``ingredient_rows`` has (setid, pos, raw_name, unii), ``aliases`` has
    (canonical_name, alias).  Texts are matched once per distinct spelling by a
    substring join; the first position per (setid, concept) is kept by a
    map-side combined minimum.
    """
    from labelmill.operators.joins import salted_join, substring_pairs

    rows = ingredient_rows.withColumn("_text", text.normalize_text(F.col("raw_name")))
    wanted = aliases.select("canonical_name", text.normalize_text(F.col("alias")).alias("needle"))
    pairs = substring_pairs(wanted, "needle", rows, "_text")
    concepts_of_text = (
        pairs.join(wanted, "needle").groupBy(F.col("text").alias("_text")).agg(F.collect_set("canonical_name").alias("_names"))
    )
    hits = salted_join(rows, concepts_of_text, "_text", ["setid", "pos"])
    hits = hits.select("setid", "pos", "raw_name", "unii", F.explode("_names").alias("canonical_name"))
    return hits.groupBy("setid", "canonical_name").agg(
        F.min(F.struct("pos", "raw_name", "unii")).alias("first")
    ).select("setid", "canonical_name", "first.pos", "first.raw_name", "first.unii")


def with_keys(terms: Column) -> Column:
    """Filter terms as (term, keys)."""
    return F.transform(terms, lambda t: F.struct(t.alias("term"), ingredients.match_keys(t).alias("keys")))


def term_table(spark: SparkSession, raw: str | None) -> Column:
    """A user's term list as (term, keys): one value of the whole query, worked out once and not for every row."""
    return spark.range(1).select(with_keys(ingredients.filter_terms(F.lit(raw)))).scalar()


def table_hits(table: Column, entry_keys: Column) -> Column:
    """The terms of a table, in order, one of whose keys is contained in an ingredient key."""
    found = F.filter(table, lambda t: F.exists(t["keys"], lambda k: F.exists(entry_keys, lambda e: F.contains(e, k))))
    return F.transform(found, lambda t: t["term"])


def term_hits(terms: Column, entry_keys: Column) -> Column:
    """The same for terms that differ by row."""
    return table_hits(with_keys(terms), entry_keys)


def record_keys(inactives: Column) -> Column:
    """All match keys of a record's inactive ingredients, in one array.

    A record's normalised name differs from its raw name in case and spacing
    only, so the raw name alone gives every key.
    """
    keys = F.transform(inactives, lambda i: ingredients.match_keys(i["raw_name"], i["unii"], broaden=True))
    return F.array_distinct(F.flatten(keys))


def entry_keys(entries: Column) -> Column:
    """As ``record_keys`` for full ingredient entries (raw text may be a whole table row)."""
    keys = F.transform(
        entries,
        lambda e: ingredients.ingredient_keys(e["raw_name"], e["display_name"], e["normalized_name"], e["unii"]),
    )
    return F.array_distinct(F.flatten(keys))


def filter_verdict(include: Column, exclude: Column, include_hits: Column, exclude_hits: Column) -> Column:
    """Any include term hits (if given) and no exclude term hits."""
    return ((F.size(include) == 0) | (F.size(include_hits) > 0)) & (F.size(exclude_hits) == 0)
