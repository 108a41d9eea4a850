"""Queries over free text, concepts, search and comparison, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import base
from catalog.tiering import assessed, products, records
from labelmill import vocab
from labelmill.functions import queries, text
from labelmill.operators import match
from labelmill.operators.grams import GramIndex
from labelmill.plans import concepts as concept_plans
from labelmill.plans import search
from labelmill.session import stage
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


# --- SQL forms ----------------------------------------------------------------

_texts = f"""
texts AS (
  SELECT 't-' || conv_id || '-' || turn AS text_id, text AS raw_text FROM conversations
  UNION ALL
  SELECT 'p' || p_partkey, '  ' || p_name || ', ' || p_size || {base.pick('MG / 5ml|ug|mcg/2.5 ML|g|%', 'p_partkey')} || ' - '
    || {base.pick('oral_susp|tablet!!!|topical cream|soln inj|GEL', 'p_partkey')}
    || CASE WHEN p_partkey % 4 = 0 THEN ' 0002-' || lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') || '-01' ELSE '' END FROM part
)"""


def _normalized(raw: str) -> str:
    """Query normalisation without look-around: digit-hyphen-digit is protected twice (overlaps)."""
    x = f"regexp_replace(replace({raw}, '_', ' '), '[^\\p{{L}}\\p{{N}}\\s/\\-%.]+', ' ', 'g')"
    for _ in range(2):
        x = f"regexp_replace({x}, '([0-9])-([0-9])', '\\1' || chr(1) || '\\2', 'g')"
    x = f"replace(replace({x}, '-', ' '), chr(1), '-')"
    x = f"regexp_replace({x}, '\\s*/\\s*', '/', 'g')"
    for spelling, unit in vocab.UNITS:
        x = f"regexp_replace({x}, '([0-9]+(?:\\.[0-9]+)?)\\s*(?:{spelling})\\b', '\\1 {unit}', 'gi')"
    return f"trim({base.squash(x)}, ' -/.,')"


def _hint(x: str, table: dict[str, str]) -> str:
    whens = " ".join(f"WHEN contains({x}, '{k}') THEN '{v}'" for k, v in table.items())
    return f"CASE {whens} END"


def normalized_cte(source: str, columns: str, name: str = "norm", raw: str = "raw_text") -> str:
    return f"""
{name} AS (
  SELECT *, sha256(lower(normalized_text) || '|' || coalesce(ndc, '') || '|' || coalesce(requested_route, '') || '|' ||
    coalesce(requested_dose_form, '') || '|' || coalesce(requested_strength, '')) AS query_key
  FROM (SELECT {columns}, normalized_text,
      nullif(regexp_extract({raw}, '\\b[0-9]{{4,5}}-[0-9]{{3,4}}-[0-9]{{1,2}}\\b|\\b[0-9]{{10,11}}\\b'), '') AS ndc,
      {_hint('lower(normalized_text)', vocab.ROUTE_HINTS)} AS requested_route,
      {_hint('lower(normalized_text)', vocab.FORM_HINTS)} AS requested_dose_form,
      nullif(regexp_extract(normalized_text, '(?i)\\b[0-9]+(?:\\.[0-9]+)?\\s*(?:mcg|mg|g|kg|mL|L|%)(?:\\s*/\\s*[0-9]+(?:\\.[0-9]+)?\\s*(?:mcg|mg|g|kg|mL|L|%))?\\b'), '')
        AS requested_strength
    FROM (SELECT *, {_normalized(raw)} AS normalized_text FROM {source}) a) b
)"""


STOP = ", ".join(base.quote(w) for w in vocab.STOPWORDS)


def _all(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def _distinct_in_order(x: str) -> str:
    return f"list_filter({x}, lambda t, i: list_position({x}, t) = i)"


def _meaningful(x: str) -> str:
    return f"list_distinct(list_filter({_all(x)}, lambda t: t NOT IN ({STOP}) AND NOT regexp_full_match(t, '[0-9]+')))"


def _kept(x: str) -> str:
    return f"list_filter({_all(x)}, lambda t: t NOT IN ({STOP}) AND NOT regexp_full_match(t, '[0-9]+'))"


_expand = "array_to_string(list_transform({0}, lambda t: coalesce(map_extract_value(MAP {{{1}}}, t), t)), ' ')".format(
    _all("raw_text"), ", ".join(f"'{k}': '{v}'" for k, v in vocab.ABBREVIATIONS.items())
)

CONCEPTS = f"""
concepts AS (
  SELECT 'c' || p_partkey AS rxcui, p_partkey AS seq, {base.pick(derived.TTYS, 'p_partkey')} AS tty,
    CASE WHEN {base.pick(derived.TTYS, 'p_partkey')} IN ('IN', 'PIN', 'MIN') THEN p_name
      ELSE p_name || ' ' || p_size || {base.pick(derived.CONCEPT_SUFFIXES, 'p_partkey')} END AS name,
    CAST((p_partkey % 10) * 5 AS DOUBLE) AS score FROM part
), useful AS (SELECT * FROM concepts WHERE tty IN ('SCD', 'SBD', 'SCDG', 'IN', 'PIN', 'MIN')),
relations AS (
  SELECT 'c' || p_partkey AS rxcui, 'c' || ing AS related_rxcui, p.p_name AS related_name FROM part p
  JOIN (SELECT p_name, min(p_partkey) AS ing FROM part WHERE {base.pick(derived.TTYS, 'p_partkey')} = 'IN' GROUP BY p_name) i
    ON i.p_name = p.p_name WHERE {base.pick(derived.TTYS, 'p_partkey')} = 'SBD'
)"""
ASKED = "asked AS (SELECT * FROM (VALUES {}) v(query_id, raw_text))".format(
    ", ".join(f"({i}, {base.quote(t)})" for i, t in derived.QUERIES)
)
NORM_ASKED = normalized_cte("asked", "query_id, raw_text")

_tty = " ".join(f"WHEN '{k}' THEN {v}" for k, v in vocab.TTY_SCORES.items())
_injection = base.any_contained("lower(name)", vocab.INJECTION_MARKERS)
_oral = "(coalesce(requested_route = 'ORAL', false) OR coalesce(requested_dose_form IN ('SOLUTION', 'SUSPENSION', 'SYRUP'), false))"


def name_points(a: int, b: int, c: int) -> str:
    return (
        f"CASE WHEN lower(name) = lower(normalized_text) THEN {a} WHEN starts_with(lower(name), lower(normalized_text)) THEN {b} "
        f"WHEN contains(lower(name), lower(normalized_text)) THEN {c} ELSE 0 END"
    )


def scored_cte(source: str, name: str = "scored") -> str:
    return f"""
{name} AS (
  SELECT *, score + CASE tty {_tty} ELSE -50 END + {name_points(120, 60, 35)}
    + CASE WHEN requested_strength IS NULL THEN 0 WHEN contains(lower(name), lower(requested_strength)) THEN 30
           WHEN tty IN ('SCD', 'SBD') THEN -12 ELSE 0 END
    + CASE WHEN len(qt) > 0 THEN len(list_intersect(qt, nt)) / len(qt) * 25.0
           + CASE WHEN len(list_intersect(qt, nt)) = 0 THEN -70 ELSE 0 END ELSE 0 END
    + CASE WHEN {_oral} THEN CASE WHEN contains(lower(name), 'oral') THEN 18 ELSE 0 END
           + CASE WHEN coalesce(contains(lower(name), lower(requested_dose_form)), false) THEN 24 ELSE 0 END
           - CASE WHEN {base.any_contained('lower(name)', vocab.NON_ORAL_MARKERS)} THEN 40 ELSE 0 END
           - CASE WHEN {_injection} THEN 35 ELSE 0 END ELSE 0 END
    - CASE WHEN NOT coalesce(requested_route IN ('INJECTABLE', 'INJECTION', 'INTRAVENOUS', 'INTRAMUSCULAR', 'SUBCUTANEOUS'), false)
           AND {_injection} THEN 35 ELSE 0 END AS rank_score
  FROM (SELECT *, {_meaningful('normalized_text')} AS qt, {_meaningful('name')} AS nt FROM {source}) s
)"""


CANDIDATES = f"""
pairs AS (
  SELECT DISTINCT query_id, rxcui FROM (SELECT query_id, unnest({_meaningful('normalized_text')}) AS token FROM norm) q
  JOIN (SELECT rxcui, unnest({_meaningful('name')}) AS token FROM useful) c USING (token)
), cands AS (
  SELECT n.*, u.rxcui, u.name, u.tty, u.score, u.seq FROM pairs JOIN useful u USING (rxcui) JOIN norm n USING (query_id)
  WHERE length(normalized_text) >= 2
), top_cands AS (
  SELECT * FROM cands
), brand AS (
  SELECT * FROM (SELECT query_id, rxcui, seq, row_number() OVER (PARTITION BY query_id ORDER BY seq, rxcui) AS rn FROM top_cands
    WHERE tty = 'SBD' AND query_id NOT IN (SELECT query_id FROM top_cands WHERE tty IN ('IN', 'PIN'))) b WHERE rn <= 3
), extra AS (
  SELECT query_id, related_rxcui AS rxcui, arg_min(related_name, seq) AS name, min(seq) AS seq FROM brand JOIN relations USING (rxcui)
  GROUP BY query_id, related_rxcui
), merged AS (
  SELECT query_id, rxcui, name, tty, score, seq FROM top_cands
  UNION ALL SELECT query_id, rxcui, name, 'IN', 0.0, seq FROM extra
  WHERE (query_id, rxcui) NOT IN (SELECT (query_id, rxcui) FROM top_cands)
), merged_full AS (SELECT n.*, m.rxcui, m.name, m.tty, m.score, m.seq FROM merged m JOIN norm n USING (query_id))"""


# --- text queries ----------------------------------------------------------------


@query(
    "normalized_queries",
    base.with_ctes(
        [_texts, normalized_cte("texts", "text_id, raw_text")],
        "SELECT text_id, normalized_text, ndc, requested_route, requested_dose_form, requested_strength, query_key FROM norm",
    ),
)
def normalized_queries(spark, sf):
    return queries.normalize_queries(derived.query_texts(spark, sf)).drop("raw_text")


@query(
    "query_tokens",
    base.with_ctes(
        [_texts],
        f"""SELECT text_id, array_to_string(list_sort(list_distinct({_all('raw_text')})), ' ') AS all_tokens,
              array_to_string(list_sort({_meaningful('raw_text')}), ' ') AS tokens, {_expand} AS expanded,
              coalesce({_kept('raw_text')}[1], '') AS first_token FROM texts""",
    ),
)
def query_tokens(spark, sf):
    raw = F.col("raw_text")
    return derived.query_texts(spark, sf).select(
        "text_id",
        F.array_join(F.array_sort(queries.candidate_tokens(raw)), " ").alias("all_tokens"),
        F.array_join(F.array_sort(queries.meaningful_tokens(raw)), " ").alias("tokens"),
        queries.expand_abbreviations(raw).alias("expanded"),
        F.coalesce(F.get(queries.meaningful_tokens(raw), F.lit(0)), F.lit("")).alias("first_token"),
    )


_base_words = "|".join([*vocab.FORM_HINTS, *vocab.ROUTE_HINTS])


@query(
    "base_drug_names",
    base.with_ctes(
        [_texts],
        f"""SELECT text_id, coalesce(nullif({base.squash(f"regexp_replace(raw_text, '\\b({_base_words})\\b', ' ', 'gi')")}, ''), raw_text)
              AS base_name FROM texts""",
    ),
)
def base_drug_names(spark, sf):
    return derived.query_texts(spark, sf).select("text_id", queries.base_drug_name(F.col("raw_text")).alias("base_name"))


@query(
    "query_variants",
    base.with_ctes(
        [_texts, f"kept AS (SELECT text_id, trim({_expand}) AS full_text, {_kept(_expand)} AS toks FROM texts)"],
        f"""SELECT DISTINCT text_id, v AS variant FROM (SELECT text_id, unnest([full_text,
              array_to_string({_distinct_in_order('toks')}, ' '), coalesce(toks[1], '')]) AS v FROM kept) x WHERE v <> ''""",
    ),
)
def query_variants(spark, sf):
    expanded = queries.expand_abbreviations(F.col("raw_text"))
    rows = derived.query_texts(spark, sf).select("text_id", expanded.alias("expanded"))
    return rows.select("text_id", F.explode(queries.query_variants(F.col("expanded"))).alias("variant"))


@query(
    "query_log",
    base.with_ctes(
        [_texts, normalized_cte("texts", "text_id, raw_text")],
        """SELECT query_key, CAST(count(*) AS BIGINT) AS asked, min(normalized_text) AS normalized_text FROM norm
           WHERE normalized_text <> '' OR ndc IS NOT NULL GROUP BY query_key""",
    ),
)
def query_log(spark, sf):
    rows = search.audit_rows(queries.normalize_queries(derived.query_texts(spark, sf)))
    rows = rows.filter("normalized_text <> '' OR ndc IS NOT NULL")
    return rows.groupBy("query_key").agg(
        F.count(F.lit(1)).alias("asked"), F.min("normalized_text").alias("normalized_text")
    )


# --- concepts -----------------------------------------------------------------------


@query(
    "concept_scores",
    base.with_ctes(
        [CONCEPTS, ASKED, NORM_ASKED, CANDIDATES, scored_cte("cands")],
        "SELECT query_id, rxcui, round(rank_score, 6) AS rank_score FROM scored",
    ),
)
def concept_scores(spark, sf):
    normalized = queries.normalize_queries(derived.search_queries(spark))
    candidates = concept_plans.token_candidates(normalized, derived.concepts(spark, sf))
    return concept_plans.score_candidates(candidates.filter(F.length("normalized_text") >= 2)).select(
        "query_id", "rxcui", F.round("rank_score", 6).alias("rank_score")
    )


@query(
    "concept_ranking",
    base.with_ctes(
        [CONCEPTS, ASKED, NORM_ASKED, CANDIDATES, scored_cte("cands")],
        """SELECT query_id, rxcui, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank_score DESC, seq) AS BIGINT) AS rank
           FROM scored""",
    ),
)
def concept_ranking(spark, sf):
    """Every candidate of every query, ranked span by span."""
    normalized = queries.normalize_queries(derived.search_queries(spark))
    candidates = concept_plans.token_candidates(normalized, derived.concepts(spark, sf))
    scored = concept_plans.score_candidates(candidates.filter(F.length("normalized_text") >= 2))
    return concept_plans.rank(scored).select("query_id", "rxcui", "rank")


@query(
    "resolved_concepts",
    base.with_ctes(
        [CONCEPTS, ASKED, NORM_ASKED, CANDIDATES, scored_cte("merged_full")],
        """SELECT query_id, rxcui, name, tty, round(rank_score, 6) AS rank_score,
             CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank_score DESC, seq) AS BIGINT) AS rank FROM scored""",
    ),
)
def resolved_concepts(spark, sf):
    normalized = queries.normalize_queries(derived.search_queries(spark))
    candidates = concept_plans.token_candidates(normalized, derived.concepts(spark, sf))
    scored = concept_plans.scored_candidates(normalized, candidates, derived.concept_relations(spark, sf))
    out = concept_plans.rank(stage(scored, "scored"))
    return out.select("query_id", "rxcui", "name", "tty", F.round("rank_score", 6).alias("rank_score"), "rank")


_words = "list_distinct(regexp_extract_all(lower(name), '[a-z0-9]+'))"
_opens = "len(list_filter(words, lambda w: starts_with(w, {0}))) > 0"
SUGGESTED = f"""
typed AS (SELECT query_id, {_expand} AS raw_text FROM asked WHERE length({base.squash('raw_text')}) >= 2),
{normalized_cte('typed', 'query_id, raw_text').strip()},
variants AS (
  SELECT DISTINCT query_id, v FROM (SELECT query_id, unnest([raw_text, array_to_string({_distinct_in_order(_kept('raw_text'))}, ' '),
    coalesce({_kept('raw_text')}[1], '')]) AS v FROM typed) x WHERE v <> ''
),
sug AS (
  SELECT *, score + {name_points(120, 50, 25)}
    + CASE WHEN len(qt) > 0 THEN opened / len(qt) * 35.0 + CASE WHEN opened = len(qt) THEN 25 ELSE 0 END ELSE 0 END
    + CASE WHEN coalesce(contains(lower(name), lower(requested_route)), false) THEN 15 ELSE 0 END
    + CASE WHEN coalesce(contains(lower(name), lower(requested_dose_form)), false) THEN 22 ELSE 0 END AS rank_score,
    CASE WHEN len(qt) = 0 THEN true
      WHEN len(qt) = 1 AND length(qt[1]) <= 4 THEN starts_with(lower(name), qt[1]) OR {_opens.format('qt[1]')}
      ELSE len(list_filter(qt, lambda t: contains(lower(name), t))) > 0 OR opened > 0 OR contains(lower(name), lower(normalized_text)) END AS keep
  FROM (SELECT *, len(list_filter(qt, lambda t: {_opens.format('t')})) AS opened FROM (
    SELECT n.*, u.rxcui, u.name, u.tty, u.score, u.seq, {_meaningful('normalized_text')} AS qt, {_words} AS words
    FROM norm n JOIN useful u ON EXISTS (SELECT 1 FROM variants v WHERE v.query_id = n.query_id AND contains(lower(u.name), v.v))) a) b
)"""


@query(
    "suggestions",
    base.with_ctes(
        [CONCEPTS, ASKED, SUGGESTED],
        f"""SELECT query_id, rxcui, name AS display_name, tty, round(rank_score, 6) AS score FROM (
              SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank_score DESC, seq, rxcui) AS rn FROM sug WHERE keep) s
            WHERE rn <= {vocab.SUGGESTION_LIMIT}""",
    ),
)
def suggestions(spark, sf):
    out = concept_plans.suggest(derived.search_queries(spark), derived.concepts(spark, sf))
    return out.withColumn("score", F.round("score", 6))


@query(
    "best_concepts",
    base.with_ctes(
        [CONCEPTS],
        """SELECT name AS display_name, arg_max(rxcui, (score, -seq)) AS rxcui, max(score) AS score FROM useful GROUP BY name""",
    ),
)
def best_concepts(spark, sf):
    """Best score per name, first one on ties."""
    rows = concept_plans.useful(derived.concepts(spark, sf)).withColumn("all", F.lit(1))
    best = concept_plans.best_per_concept(rows, "all", "name")
    return best.select(F.col("name").alias("display_name"), "rxcui", "score")


# --- search -------------------------------------------------------------------------

_lookup = """
named AS (SELECT query_id, pass, requested_dose_form, requested_route, n.product_name
  FROM (SELECT * FROM asks WHERE ndc IS NULL AND search_text <> '') a, (SELECT DISTINCT product_name FROM records) n
  WHERE contains(lower(n.product_name), lower(a.search_text))),
lookup AS (
  SELECT n.query_id, n.pass, n.requested_dose_form, n.requested_route, r.* FROM named n JOIN records r ON r.product_name = n.product_name
  UNION ALL
  SELECT a.query_id, a.pass, a.requested_dose_form, a.requested_route, r.* FROM asks a JOIN records r ON r.ndcs = a.ndc
), results AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY query_id, setid ORDER BY pass, seq) AS rn FROM lookup l
    WHERE (requested_dose_form IS NULL OR coalesce(dosage_form, '') = '' OR contains(lower(dosage_form), lower(requested_dose_form)))
      AND (requested_route IS NULL OR coalesce(route, '') = '' OR contains(lower(route), lower(requested_route)))) q WHERE rn = 1
)"""
_direct = """
asks AS (SELECT query_id, 0 AS pass, normalized_text AS search_text, ndc, requested_route, requested_dose_form FROM norm
  WHERE normalized_text <> '' OR ndc IS NOT NULL)"""
_widened = f"""
{scored_cte("merged_full").strip()},
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank_score DESC, seq) AS rank FROM scored),
names AS (SELECT query_id, arg_min(name, rank) AS name, min(rank) AS rank FROM ranked
  WHERE tty IN ('IN', 'PIN') AND lower(name) <> lower(normalized_text) GROUP BY query_id, lower(name)),
asks AS (
  SELECT query_id, 0 AS pass, normalized_text AS search_text, ndc, requested_route, requested_dose_form FROM norm
  UNION ALL SELECT n.query_id, s.rank, s.name, n.ndc, n.requested_route, n.requested_dose_form FROM names s JOIN norm n USING (query_id))"""

TO_RESULTS = [base.LINES, base.RECORDS, ASKED, NORM_ASKED, CONCEPTS, CANDIDATES, _widened, _lookup]


_titles = """
titles AS (SELECT setid, seq, ndcs, concat_ws(' ', product_name, dosage_form, route) AS title FROM records)"""
_shop_queries = f"""
shop AS (SELECT p_partkey AS query_id, p_name || {base.pick(' tablet| oral solution||  syrup oral', 'p_partkey')} AS raw_text FROM part)"""
_broad = f"""
broad AS (
  SELECT query_id, setid, seq, title FROM (
    SELECT *, coalesce(nullif({base.squash(f"regexp_replace(normalized_text, '\\b({_base_words})\\b', ' ', 'gi')")}, ''), normalized_text) AS base_name
    FROM norm) n JOIN titles t ON contains(lower(title), lower(base_name))
  WHERE ndc IS NULL AND normalized_text <> '' AND (requested_dose_form IS NULL OR contains(lower(title), lower(requested_dose_form)))
    AND (requested_route IS NULL OR contains(lower(title), lower(requested_route)))
)"""
TO_BROAD = [base.LINES, base.RECORDS, _titles, _shop_queries, normalized_cte("shop", "query_id, raw_text"), _broad]


def _shop(spark, sf):
    """A query per part, and the listing that they search: titles of all labels."""
    p = F.col("p_partkey")
    form = F.split_part(F.lit(" tablet| oral solution||  syrup oral"), F.lit("|"), (p % 4 + 1).cast("int"))
    asked = derived.table(spark, sf, "part").select(p.alias("query_id"), F.concat("p_name", form).alias("raw_text"))
    title = F.concat_ws(" ", "product_name", "dosage_form", "route")
    listings = stage(records(spark, sf).withColumn("product_name", title).select(*search.RESULT_COLUMNS), "listings")
    return asked, listings


@query("broad_search", base.with_ctes(TO_BROAD, "SELECT query_id, setid, title AS product_name FROM broad"))
def broad_search(spark, sf):
    """Base name search with title filter; queries grow with the data."""
    return search.broad_search(*_shop(spark, sf)).select("query_id", "setid", "product_name")


@query(
    "merged_search",
    base.with_ctes(
        TO_BROAD, "SELECT query_id, setid, CASE WHEN seq % 3 = 0 THEN 'local' ELSE 'live' END AS source FROM broad"
    ),
)
def merged_search(spark, sf):
    """A local index of a third of the parts before the live listing of all."""
    asked, listings = _shop(spark, sf)
    names = search.name_index(listings)  # written once, read by both searches
    return search.merged_broad_search(asked, listings.filter("seq % 3 = 0"), listings, names).select("query_id", "setid", "source")


@query(
    "expanded_products",
    base.with_ctes(
        [base.LINES, base.RECORDS],
        """SELECT DISTINCT p_partkey AS query_id, setid, product_name FROM part
             JOIN records ON seq - seq % 5 = p_partkey - p_partkey % 5 OR seq = p_partkey + 3""",
    ),
)
def expanded_products(spark, sf):
    """Products by concept id: every part asks for two concepts, a product has that of its family of parts, or its own."""
    p = F.col("p_partkey")
    part = derived.table(spark, sf, "part")
    family = F.concat(F.lit("f"), (p - p % 5).cast("string"))
    own = F.concat(F.lit("c"), (p + 3).cast("string"))
    candidates = part.select(p.alias("query_id"), F.explode(F.array(family, own)).alias("rxcui"))
    rows = records(spark, sf).select(*search.RESULT_COLUMNS)
    ids = F.array(F.concat(F.lit("f"), (F.col("seq") - F.col("seq") % 5).cast("string")), F.concat(F.lit("c"), F.col("seq").cast("string")))
    products = rows.withColumn("rxcui", F.explode(ids))
    found = search.expand_candidates(candidates, products, ["seq", "setid", "rxcui"])
    return found.select("query_id", "setid", "product_name")


@query(
    "product_lookup",
    base.with_ctes(
        [base.LINES, base.RECORDS, ASKED, NORM_ASKED, _direct, _lookup], "SELECT query_id, setid, product_name FROM results"
    ),
)
def product_lookup(spark, sf):
    return search.search(derived.search_queries(spark), records(spark, sf)).select("query_id", "setid", "product_name")


def _results(spark, sf, rows):
    return search.search(derived.search_queries(spark), rows, derived.concepts(spark, sf), derived.concept_relations(spark, sf))


def _staged_records(spark, sf):
    """The product records, written once for the several lookups of a search, which each read a few columns."""
    return stage(records(spark, sf), "records")


@query(
    "search_results",
    base.with_ctes(
        TO_RESULTS, "SELECT query_id, CAST(pass AS BIGINT) AS pass, setid, product_name FROM results"
    ),
)
def search_results(spark, sf):
    return _results(spark, sf, _staged_records(spark, sf)).select("query_id", "pass", "setid", "product_name")


INCLUDE, EXCLUDE = "PEG; glycerol, D-Sorbitol", "red dye\nsucrose"
_fit = {
    "PEG": ["peg"],
    "glycerol": ["glycerin"],
    "D-Sorbitol": ["sorbitol"],
    "red dye": ["red dye", "fdc red", "dc red"],
    "sucrose": ["sucrose"],
}
_hit_sql = {
    "PEG": "raw_name = 'polyethylene glycol 400'",
    "glycerol": "raw_name = 'GLYCERIN'",
    "D-Sorbitol": "raw_name = 'Sorbitol Solution 70%'",
    "red dye": "raw_name IN ('FD&C Red No. 40', 'D&C Red No. 33')",
    "sucrose": "raw_name = 'sucrose'",
}


def _terms_sql(terms: list[str]) -> str:
    parts = ", ".join(
        f"CASE WHEN count(*) FILTER (ing_role = 'inactive' AND {_hit_sql[t]}) > 0 THEN {base.quote(t)} END" for t in terms
    )
    return f"concat_ws('; ', {parts})"


_terms = f"""
terms AS (
  SELECT setid, {_terms_sql(['PEG', 'glycerol', 'D-Sorbitol'])} AS inc, {_terms_sql(['red dye', 'sucrose'])} AS exc,
    coalesce(string_agg(raw_name, ', ' ORDER BY pos) FILTER (ing_role = 'inactive'), '') AS inactive_ingredients_raw,
    (SELECT string_agg(strength, ', ' ORDER BY p) FROM (SELECT strength, min(pos) AS p FROM ings j
       WHERE j.setid = i.setid AND strength IS NOT NULL GROUP BY strength) s) AS strength_summary
  FROM ings i GROUP BY setid
)"""


@query(
    "filter_terms",
    base.with_ctes(
        [base.LINES, _terms],
        """SELECT setid, inc AS include_terms, exc AS exclude_terms, CAST(inc <> '' AND exc = '' AS INTEGER) AS matches_filter
           FROM terms""",
    ),
)
def filter_terms(spark, sf):
    """Include and exclude terms found on every label."""
    rows = records(spark, sf).select("setid", match.record_keys(F.col("inactives")).alias("keys"))
    # a subquery may not stand inside a lambda: the tables are columns first
    rows = rows.withColumns({"include": match.term_table(spark, INCLUDE), "exclude": match.term_table(spark, EXCLUDE)})
    include, exclude = F.col("include"), F.col("exclude")
    rows = rows.withColumns(
        {
            "include_terms": match.table_hits(include, F.col("keys")),
            "exclude_terms": match.table_hits(exclude, F.col("keys")),
        }
    )
    verdict = match.filter_verdict(include, exclude, F.col("include_terms"), F.col("exclude_terms"))
    return rows.select(
        "setid",
        F.array_join("include_terms", "; ").alias("include_terms"),
        F.array_join("exclude_terms", "; ").alias("exclude_terms"),
        verdict.cast("int").alias("matches_filter"),
    )


@query(
    "excipient_comparison",
    base.with_ctes(
        [*TO_RESULTS, _terms],
        """SELECT query_id, setid, product_name, labeler, dosage_form, route, ndcs, strength_summary, inactive_ingredients_raw,
             inc AS matched_include_terms, exc AS matched_exclude_terms, CAST(inc <> '' AND exc = '' AS INTEGER) AS matches_filter
           FROM results JOIN terms USING (setid) WHERE coalesce(product_type, '') = '' OR contains(product_type, 'HUMAN')""",
    ),
)
def excipient_comparison(spark, sf):
    """Search, widen by ingredient, compare inactive ingredients of every hit."""
    products = _staged_records(spark, sf)
    rows = search.comparison_rows(_results(spark, sf, products), products, INCLUDE, EXCLUDE)
    return rows.select(
        "query_id", "setid", "product_name", "labeler", "dosage_form", "route", F.array_join("ndcs", "; ").alias("ndcs"),
        "strength_summary", "inactive_ingredients_raw",
        F.array_join("matched_include_terms", "; ").alias("matched_include_terms"),
        F.array_join("matched_exclude_terms", "; ").alias("matched_exclude_terms"),
        F.col("matches_filter").cast("int").alias("matches_filter"),
    )


_BODY = "query struct<normalized_text:string,ndc:string>, comparison_rows array<struct<setid:string,matches_filter:boolean>>, matching_products array<struct<setid:string>>"


@query(
    "search_responses",
    base.with_ctes(
        [*TO_RESULTS, _terms],
        """SELECT query_id, normalized_text, setid, inc <> '' AND exc = '' AS matches_filter
           FROM results JOIN terms USING (setid) JOIN (SELECT query_id, normalized_text FROM norm) USING (query_id)
           WHERE coalesce(product_type, '') = '' OR contains(product_type, 'HUMAN')""",
    ),
)
def search_responses(spark, sf):
    """Responses as JSON, in parts, and read back: the rows of a query, of which the matching ones are listed again."""
    products = _staged_records(spark, sf)
    rows = search.comparison_rows(_results(spark, sf, products), products, INCLUDE, EXCLUDE)
    normalized = queries.normalize_queries(derived.search_queries(spark))
    packed = search.responses(normalized, rows, chunk=50).select("query_id", F.from_json("body", _BODY).alias("b"))
    shown = packed.select("query_id", "b.query.normalized_text", F.explode("b.comparison_rows").alias("r"), "b.matching_products.setid")
    listed = F.array_contains("setid", F.col("r.setid"))
    return shown.filter(listed == F.col("r.matches_filter")).select("query_id", "normalized_text", "r.setid", "r.matches_filter")


@query(
    "human_results",
    base.with_ctes(
        [base.LINES, base.RECORDS, ASKED, NORM_ASKED, _direct, _lookup],
        "SELECT query_id, setid FROM results WHERE coalesce(product_type, '') = '' OR contains(product_type, 'HUMAN')",
    ),
)
def human_results(spark, sf):
    rows = records(spark, sf)
    return search.human_results(search.search(derived.search_queries(spark), rows), rows).select("query_id", "setid")


@query(
    "name_containment",
    """SELECT DISTINCT a.w AS needle, p.p_name AS text FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part
         UNION SELECT DISTINCT unnest(string_split(lower(p_type), ' ')) FROM part UNION SELECT DISTINCT lower(p_brand) FROM part) a
       JOIN (SELECT DISTINCT p_name FROM part) p ON contains(p.p_name, a.w)""",
)
def name_containment(spark, sf):
    """Substring join of the words of names, types and brands with product names."""
    part = derived.table(spark, sf, "part").select("p_name", "p_type", "p_brand")
    words = (
        part.select(F.explode(F.split("p_name", " ")).alias("w"))
        .union(part.select(F.explode(F.split(F.lower("p_type"), " "))))
        .union(part.select(F.lower("p_brand")))
    )
    return GramIndex.build(part, "p_name").find(words, "w")


@query(
    "liquid_names",
    "SELECT p_partkey, CAST({} AS INTEGER) AS is_liquid FROM (SELECT p_partkey, lower(p_name || ' ' || {}) AS n FROM part) x".format(
        base.any_contained("n", [*vocab.STRONG_FORMS, *vocab.AMBIGUOUS_FORMS]), base.pick(derived.FORMS, "p_partkey")
    ),
)
def liquid_names(spark, sf):
    p = F.col("p_partkey")
    name = F.lower(F.concat_ws(" ", "p_name", derived._pick(derived.FORMS, p)))
    words = [*vocab.STRONG_FORMS, *vocab.AMBIGUOUS_FORMS]
    return derived.table(spark, sf, "part").select(
        "p_partkey", text.contains_any(name, words).cast("int").alias("is_liquid")
    )


_cand_sql = """
cand AS (SELECT p_partkey AS seq, CASE WHEN p_partkey % 3 = 0 THEN 'set-' || p_partkey % 100 ELSE '' END AS setid,
    CASE WHEN p_partkey % 3 = 1 THEN '00' || p_partkey % 50 ELSE '' END AS ndc, '  ' || upper(p_name) AS product_name, p_brand AS labeler
  FROM part)"""
_key_sql = """CASE WHEN setid <> '' THEN 'setid:' || setid WHEN ndc <> '' THEN 'ndc:' || ndc ELSE 'name:' || lower(trim(product_name)) END"""


def _candidates(spark, sf):
    p = F.col("p_partkey")
    return derived.table(spark, sf, "part").select(
        p.alias("seq"),
        F.when(p % 3 == 0, F.concat(F.lit("set-"), (p % 100).cast("string"))).otherwise("").alias("setid"),
        F.when(p % 3 == 1, F.concat(F.lit("00"), (p % 50).cast("string"))).otherwise("").alias("ndc"),
        F.concat(F.lit("  "), F.upper("p_name")).alias("product_name"),
        F.col("p_brand").alias("labeler"),
    )


@query(
    "candidate_index",
    base.with_ctes(
        [_cand_sql],
        f"""SELECT candidate_key, labeler FROM (SELECT {_key_sql} AS candidate_key, labeler,
              row_number() OVER (PARTITION BY {_key_sql} ORDER BY seq % 2 DESC, seq DESC) AS rn FROM cand) c WHERE rn = 1""",
    ),
)
def candidate_index(spark, sf):
    """Stored candidates (even parts) merged with new ones (odd parts), last wins."""
    rows = _candidates(spark, sf)
    merged = search.merge_candidates(rows.filter("seq % 2 = 0"), rows.filter("seq % 2 = 1"), ["seq"])
    return merged.select("candidate_key", "labeler")


@query(
    "result_dedupe",
    base.with_ctes(
        [_cand_sql],
        """SELECT query_id, k AS result_key, labeler FROM (SELECT labeler AS query_id, labeler, coalesce(nullif(setid, ''), nullif(ndc, ''), lower(product_name)) AS k,
             row_number() OVER (PARTITION BY labeler, coalesce(nullif(setid, ''), nullif(ndc, ''), lower(product_name)) ORDER BY seq) AS rn
             FROM cand) c WHERE rn = 1""",
    ),
)
def result_dedupe(spark, sf):
    rows = _candidates(spark, sf).withColumn("query_id", F.col("labeler")).withColumnRenamed("ndc", "rxcui")
    out = search.dedupe_results(rows, ["seq"])
    return out.select("query_id", search.result_key().alias("result_key"), "labeler")


@query(
    "local_first",
    """SELECT p_brand, p_name, CAST(min(p_partkey) AS BIGINT) AS first_part, CAST(count(*) AS BIGINT) AS rows, src AS source FROM (
         SELECT *, CASE WHEN p_size <= 5 THEN 'local' ELSE 'live' END AS src, bool_or(p_size <= 5) OVER (PARTITION BY p_brand, p_name) AS has_local
         FROM part) p WHERE src = 'local' OR NOT has_local GROUP BY p_brand, p_name, src""",
)
def local_first(spark, sf):
    """Small packs play the local index, the others the live listing."""
    part = derived.table(spark, sf, "part").select("p_brand", "p_name", "p_partkey", "p_size")
    local = part.filter("p_size <= 5").withColumn("source", F.lit("local"))
    live = part.filter("p_size > 5").withColumn("source", F.lit("live"))
    rows = search.prefer_local(local, live, ["p_brand", "p_name"])
    return rows.groupBy("p_brand", "p_name", "source").agg(
        F.min("p_partkey").alias("first_part"), F.count(F.lit(1)).alias("rows")
    )


@query(
    "products_by_ndc",
    base.with_ctes(
        [base.LINES, base.RECORDS],
        """, wanted AS (SELECT DISTINCT 'set-' || seq AS label, CASE WHEN seq % 3 = 0 THEN 'none' ELSE max(ndcs) OVER (PARTITION BY seq) END AS wanted_ndc FROM records)
           SELECT label AS setid, wanted_ndc, ndcs FROM (SELECT w.*, r.ndcs, row_number() OVER (PARTITION BY label ORDER BY r.ndcs = wanted_ndc DESC, r.setid) AS rn
             FROM wanted w JOIN records r ON 'set-' || r.seq = w.label) x WHERE rn = 1""".lstrip(),
    ).replace("\n, wanted", ",\nwanted"),
)
def products_by_ndc(spark, sf):
    """The variant of a label that lists an NDC, else its first variant."""
    rows = records(spark, sf)
    variants = rows.select(
        F.concat(F.lit("set-"), F.col("seq").cast("string")).alias("setid"),
        "seq",
        "ndcs",
        F.col("setid").alias("subject_seq"),
    )
    wanted = variants.groupBy("setid", "seq").agg(F.max(F.get("ndcs", F.lit(0))).alias("last"))
    wanted = wanted.select("setid", F.when(F.col("seq") % 3 == 0, "none").otherwise(F.col("last")).alias("wanted_ndc"))
    out = search.products_of(wanted, variants)
    return out.select("setid", "wanted_ndc", F.get("ndcs", F.lit(0)).alias("ndcs"))


@query(
    "live_snapshot",
    f"""SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
          FROM events) e WHERE rn = 1 AND ts + INTERVAL {vocab.SNAPSHOT_TTL_HOURS} HOUR > (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
)
def live_snapshot(spark, sf):
    """Latest event per user that has not expired an hour before the last event."""
    events = derived.table(spark, sf, "events").select("user_id", "event_id", "event_type", "value", "ts")
    rows = search.live_snapshot(events, ["user_id"], "ts", hour_before_last(events), tie="event_id")
    return rows.select("user_id", "event_id", "event_type", "value")


def hour_before_last(events):
    """The reading time of the snapshot: one value, an hour before the last event."""
    return events.agg(F.max("ts")).scalar() - F.expr("INTERVAL 1 HOUR")
