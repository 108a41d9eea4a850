"""Free-text drug queries: normalisation, hints, tokens, variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill import vocab
from labelmill.functions import text


def normalize_query_text(c: Column) -> Column:
    c = F.translate(F.coalesce(c, F.lit("")), "_", " ")
    c = F.regexp_replace(c, r"(?U)[^\p{L}\p{N}\s/\-%.]+", " ")
    # a hyphen survives only between two digits
    c = F.regexp_replace(c, r"(?<!\d)-|-(?!\d)", " ")
    c = F.regexp_replace(c, r"(?U)\s*/\s*", "/")
    for spelling, unit in vocab.UNITS:
        c = F.regexp_replace(c, rf"(?iuU)(\d+(?:\.\d+)?)\s*(?:{spelling})\b", f"$1 {unit}")
    return text.strip_chars(text.squash(c), " -/.,")


def query_ndc(raw: Column) -> Column:
    return text.blank_to_null(F.regexp_extract(raw, "(?U)" + vocab.QUERY_NDC_PATTERN, 0))


def query_strength(normalized: Column) -> Column:
    return text.blank_to_null(F.regexp_extract(normalized, "(?U)" + vocab.QUERY_STRENGTH_PATTERN, 0))


def hint(lowered: Column, table: dict[str, str]) -> Column:
    """Value of the first table key contained in the text."""
    return F.coalesce(*[F.when(F.contains(lowered, F.lit(k)), F.lit(v)) for k, v in table.items()])


def query_key(normalized: Column, ndc: Column, route: Column, form: Column, strength: Column) -> Column:
    parts = [F.lower(normalized)] + [F.coalesce(c, F.lit("")) for c in (ndc, route, form, strength)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def normalize_queries(df: DataFrame, raw: str = "raw_text") -> DataFrame:
    """Add the structured fields of a query to every row."""
    out = df.withColumn("normalized_text", normalize_query_text(text.strip(F.col(raw))))
    lowered = F.lower("normalized_text")
    out = out.select(
        "*",
        query_ndc(F.col(raw)).alias("ndc"),
        hint(lowered, vocab.ROUTE_HINTS).alias("requested_route"),
        hint(lowered, vocab.FORM_HINTS).alias("requested_dose_form"),
        query_strength(F.col("normalized_text")).alias("requested_strength"),
    )
    return out.withColumn(
        "query_key",
        query_key(
            F.col("normalized_text"),
            F.col("ndc"),
            F.col("requested_route"),
            F.col("requested_dose_form"),
            F.col("requested_strength"),
        ),
    )


def all_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))


def candidate_tokens(c: Column) -> Column:
    return F.array_distinct(all_tokens(c))


def meaningful_tokens(c: Column) -> Column:
    """Tokens that are neither stop words nor numbers, first-seen order."""
    return F.array_distinct(
        F.filter(all_tokens(c), lambda t: ~t.isin(vocab.STOPWORDS) & ~F.rlike(t, F.lit("^[0-9]+$")))
    )


def expand_abbreviations(c: Column) -> Column:
    pairs = [F.lit(x) for pair in vocab.ABBREVIATIONS.items() for x in pair]
    table = F.create_map(*pairs)
    return F.array_join(
        F.transform(all_tokens(c), lambda t: F.coalesce(F.try_element_at(table, t), t)), " "
    )


def query_variants(c: Column) -> Column:
    """Full text, its meaningful tokens, its first meaningful token."""
    tokens = meaningful_tokens(c)
    variants = F.array(
        text.squash(c), F.array_join(tokens, " "), F.coalesce(F.get(tokens, F.lit(0)), F.lit(""))
    )
    return F.array_distinct(F.filter(variants, lambda v: v != ""))


def base_drug_name(c: Column) -> Column:
    """Query text without route and dose form words; the text itself if nothing is left."""
    words = "|".join([*vocab.FORM_HINTS, *vocab.ROUTE_HINTS])
    rest = text.squash(F.regexp_replace(c, rf"(?iU)\b(?:{words})\b", " "))
    return F.coalesce(text.blank_to_null(rest), c)
