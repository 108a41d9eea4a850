"""Shared SQL for the comparison queries: the derived label views and their tiers.

The SQL is written for DuckDB and states the expected results independently of
the Spark code: flat rows, joins and aggregates instead of arrays.
"""

from __future__ import annotations

from labelmill import vocab
from labelmill.sources import derived


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def pick(choices: str, index: str) -> str:
    n = len(choices.split("|"))
    return f"split_part({quote(choices)}, '|', CAST(({index}) % {n} + 1 AS INTEGER))"


def first_keyword(text: str, words: list[str]) -> str:
    whens = " ".join(f"WHEN contains({text}, {quote(w)}) THEN {quote(w)}" for w in words)
    return f"CASE {whens} END"


def any_contained(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {quote(w)})" for w in words) + ")"


def squash(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def normalize_text(x: str) -> str:
    cleaned = f"regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_\\s-]', ' ', 'g')"
    return squash(f"regexp_replace({cleaned}, '-+', '-', 'g')")


def title_case(x: str) -> str:
    runs = f"regexp_extract_all({x}, '\\p{{L}}+|[^\\p{{L}}]+')"
    return f"array_to_string(list_transform({runs}, lambda r: CASE WHEN r[1] = 'ß' THEN 'Ss' ELSE upper(r[1]) END || lower(r[2:])), '')"


def with_ctes(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


LINES = f"""
lines AS MATERIALIZED (
  SELECT l_partkey, span, nth // {derived.LABEL_SIZE} AS block, nth % {derived.LABEL_SIZE} + 1 AS pos, l_orderkey, l_suppkey
  FROM (SELECT l_partkey, l_orderkey, l_suppkey, l_orderkey // {derived.ORDER_SPAN} AS span,
          row_number() OVER (PARTITION BY l_partkey, l_orderkey // {derived.ORDER_SPAN}
            ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_shipdate) - 1 AS nth
        FROM lineitem) x
), ings AS MATERIALIZED (
  SELECT 'set-' || l_partkey || '-' || span || '-' || block AS setid, l_partkey, span, block, pos,
    CASE WHEN pos <= 2 THEN 'active' ELSE 'inactive' END AS ing_role, raw_name,
    CASE WHEN l_suppkey % 11 <> 0 THEN upper(substr(md5(lower(raw_name)), 1, 10)) END AS unii,
    CASE WHEN pos <= 2 THEN (l_suppkey % 50 + 1) || ' mg/5 mL' END AS strength
  FROM (SELECT *, CASE WHEN pos <= 2 AND l_partkey % 9 = 0 THEN 'AGENT ' || l_partkey
            WHEN pos <= 2 THEN {pick(derived.ACTIVES, 'l_partkey * 7 + l_suppkey')}
            ELSE {pick(derived.INACTIVES, 'l_orderkey + l_suppkey')} END AS raw_name FROM lines) y
)"""

RECORDS = f"""
records AS (
  SELECT i.setid, l_partkey AS seq, 'part' || (l_partkey % 6 + 1) || '.zip' AS source_file, p_name AS product_name,
    p_brand || ' Site ' || block AS labeler,
    nullif({pick(derived.FORMS, 'l_partkey + block * 5 + span')}, '~') AS dosage_form,
    nullif({pick(derived.ROUTES, 'l_partkey + block * 3 + span')}, '~') AS route,
    CASE WHEN (l_partkey + block) % 17 = 0 THEN 'VETERINARY LABEL'
         WHEN (l_partkey + block) % 17 <> 1 THEN 'HUMAN PRESCRIPTION DRUG LABEL' END AS product_type,
    lpad(CAST(l_partkey % 100000 AS VARCHAR), 5, '0') || '-' || lpad(CAST(block % 900 + 100 AS VARCHAR), 3, '0') || '-'
      || lpad(CAST(span % 100 AS VARCHAR), 2, '0') AS ndcs
  FROM ings i JOIN part ON p_partkey = l_partkey WHERE pos = 1
)"""

_form, _route = "lower(dosage_form)", "lower(route)"
CLASSED = f"""
classed AS (
  SELECT *, form_class IN ('strong', 'ambiguous') AND route_class <> 'excluded' AS should_process FROM (
    SELECT * EXCLUDE (fo, fs, fa, ro, ri),
      CASE WHEN fo IS NOT NULL THEN 'excluded' WHEN fs IS NOT NULL THEN 'strong' WHEN fa IS NOT NULL THEN 'ambiguous'
           ELSE 'non_liquid' END AS form_class,
      CASE WHEN coalesce(route, '') = '' THEN 'blank' WHEN ro IS NOT NULL THEN 'excluded' WHEN ri IS NOT NULL THEN 'oral'
           ELSE 'excluded' END AS route_class,
      CASE WHEN fo IS NULL THEN coalesce(fs, fa) END AS included_form_match, fo AS excluded_form_match,
      CASE WHEN ro IS NULL THEN ri END AS included_route_match,
      CASE WHEN coalesce(route, '') = '' THEN NULL WHEN ro IS NOT NULL THEN ro WHEN ri IS NULL THEN route END
        AS excluded_route_match,
      coalesce(product_type, '') = '' OR contains(upper(product_type), 'HUMAN') AS is_human
    FROM (SELECT *, {first_keyword(_form, vocab.EXCLUDED_FORMS)} AS fo, {first_keyword(_form, vocab.STRONG_FORMS)} AS fs,
            {first_keyword(_form, vocab.AMBIGUOUS_FORMS)} AS fa, {first_keyword(_route, vocab.EXCLUDED_ROUTES)} AS ro,
            {first_keyword(_route, vocab.ORAL_ROUTES)} AS ri FROM records) a) b
)"""


def hits(profile: str) -> str:
    """(setid, concept) hits: the first position and the first alias found there."""
    concepts = vocab.PIPELINE_CONCEPTS if profile == "pipeline" else vocab.APP_CONCEPTS
    shown = normalize_text("raw_name") if profile == "pipeline" else "lower(raw_name)"
    arms = [
        f"SELECT setid, {i} AS idx, {quote(c)} AS concept, pos, raw_name, unii, {first_keyword('t', a)} AS term FROM shown "
        f"WHERE {any_contained('t', a)}"
        for i, (c, a) in enumerate(concepts.items())
    ]
    return f"""
shown AS (SELECT setid, pos, raw_name, unii, {shown} AS t FROM ings WHERE ing_role = 'inactive'),
all_hits AS ({' UNION ALL '.join(arms)}),
hits AS (
  SELECT setid, idx, concept, CASE WHEN concept IN ('sorbitol', 'mannitol') THEN 'high' ELSE 'moderate' END AS category,
    min(pos) AS pos, arg_min(raw_name, pos) AS raw_name, arg_min(coalesce(unii, ''), pos) AS unii, arg_min(term, pos) AS term
  FROM all_hits GROUP BY setid, idx, concept
),
listed AS (
  SELECT setid, string_agg(concept, '; ' ORDER BY idx) AS names, string_agg(raw_name, '; ' ORDER BY idx) AS raws,
    string_agg(unii, '; ' ORDER BY idx) AS uniis, string_agg(term, '; ' ORDER BY idx) AS terms,
    bool_or(category = 'high') AS any_high FROM hits GROUP BY setid
)"""


def assessed(profile: str) -> str:
    visible = "c.is_human AND c.should_process" if profile == "pipeline" else "true"
    return f"""
assessed AS (
  SELECT *, CASE WHEN concern_tier = 'review' THEN {quote(vocab.REVIEW_REASON[profile])} END AS review_reason,
    CASE WHEN NOT is_human THEN 'non_human_product' WHEN form_class IN ('excluded', 'non_liquid') THEN 'excluded_form'
         WHEN route_class = 'excluded' THEN 'excluded_route' WHEN concern_tier = 'excluded' THEN 'no_sugar_alcohol_match' END
      AS exclusion_reason
  FROM (SELECT c.*, coalesce(l.names, '') AS names, coalesce(l.raws, '') AS raws, coalesce(l.uniis, '') AS uniis,
          coalesce(l.terms, '') AS terms,
          CASE WHEN NOT should_process OR l.names IS NULL THEN 'excluded'
               WHEN form_class = 'ambiguous' AND route_class = 'blank' THEN 'review'
               WHEN any_high THEN 'high' ELSE 'moderate' END AS concern_tier
        FROM classed c LEFT JOIN listed l ON l.setid = c.setid AND {visible}) z
)"""


TEXTS = """
texts AS (
  SELECT setid,
    string_agg(raw_name, '; ' ORDER BY pos) FILTER (ing_role = 'active') AS active_ingredients_raw,
    string_agg(strength, '; ' ORDER BY pos) FILTER (ing_role = 'active') AS active_strength,
    string_agg(unii, '; ' ORDER BY pos) FILTER (ing_role = 'active' AND unii IS NOT NULL) AS active_ingredients_unii,
    string_agg(raw_name, '; ' ORDER BY pos) FILTER (ing_role = 'inactive') AS inactive_ingredients_raw,
    coalesce(string_agg(coalesce(unii, ''), '; ' ORDER BY pos) FILTER (ing_role = 'inactive'), '') AS inactive_ingredients_unii
  FROM ings GROUP BY setid
)"""

ROWS = f"""{TEXTS},
stored AS (
  SELECT a.setid AS spl_setid, product_name, labeler, dosage_form, {normalize_text("coalesce(dosage_form, '')")} AS normalized_form,
    form_class, route, {normalize_text("coalesce(route, '')")} AS normalized_route, route_class, ndcs,
    active_ingredients_raw, active_strength, active_ingredients_unii, concern_tier,
    CASE WHEN concern_tier = 'excluded' THEN 'excluded' ELSE 'included' END AS inclusion_decision, review_reason,
    included_form_match, excluded_form_match, included_route_match, excluded_route_match,
    inactive_ingredients_raw, inactive_ingredients_unii,
    names AS matched_sugar_alcohols, raws AS matched_sugar_alcohol_terms, uniis AS matched_sugar_alcohol_uniis, source_file,
    should_process, seq
  FROM assessed a JOIN texts t USING (setid) WHERE is_human
)"""

ALTERNATIVES = """
tiered AS (SELECT * FROM stored WHERE concern_tier <> 'excluded'),
avoid AS (
  SELECT DISTINCT u AS unii, n AS name FROM (
    SELECT unnest(string_split(active_ingredients_unii, '; ')) AS u, matched_sugar_alcohols AS m FROM tiered
    WHERE active_ingredients_unii IS NOT NULL) q, unnest(string_split(m, '; ')) AS s(n)
),
promoted AS (
  SELECT spl_setid, string_agg(DISTINCT name, '; ' ORDER BY name) AS alternative_sugar_alcohols
  FROM (SELECT spl_setid, unnest(string_split(active_ingredients_unii, '; ')) AS unii FROM stored c
        WHERE concern_tier = 'excluded' AND should_process AND active_ingredients_unii IS NOT NULL
          AND NOT EXISTS (SELECT 1 FROM tiered t WHERE lower(coalesce(t.product_name, '')) = lower(coalesce(c.product_name, ''))
            AND lower(coalesce(t.labeler, '')) = lower(coalesce(c.labeler, '')))) u JOIN avoid USING (unii)
  GROUP BY spl_setid
),
products AS (
  SELECT * EXCLUDE (should_process), NULL AS alternative_sugar_alcohols FROM tiered
  UNION ALL
  SELECT s.* EXCLUDE (should_process) REPLACE ('alternative' AS concern_tier, 'included' AS inclusion_decision,
      NULL AS included_form_match, NULL AS excluded_form_match, NULL AS included_route_match, NULL AS excluded_route_match),
    p.alternative_sugar_alcohols
  FROM stored s JOIN promoted p USING (spl_setid)
)"""

TO_ASSESSED = [LINES, RECORDS, CLASSED, hits("pipeline"), assessed("pipeline")]
TO_ASSESSED_APP = [LINES, RECORDS, CLASSED, hits("app"), assessed("app")]
TO_STORED = [*TO_ASSESSED, ROWS]
TO_PRODUCTS = [*TO_STORED, ALTERNATIVES]
