"""Queries over label XML and label versions, with their SQL.

The XML is rendered by Spark from the derived labels and read back by the
label reader; the SQL states what was rendered.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import base
from labelmill import vocab
from labelmill.functions.diff import with_inline_diff
from labelmill.plans import changes, pipeline
from labelmill.sources import derived, label_xml

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def parsed(spark, sf, parts="all"):
    return label_xml.parse_documents(derived.label_documents(spark, sf), parts)


@query(
    "parsed_records",
    base.with_ctes(
        [base.LINES, base.RECORDS, base.TEXTS],
        """SELECT setid, product_name, labeler, dosage_form, nullif(route, '') AS route, ndcs, active_ingredients_raw,
             active_strength, active_ingredients_unii, inactive_ingredients_raw, inactive_ingredients_unii, product_type
           FROM records JOIN texts USING (setid)""",
    ),
)
def parsed_records(spark, sf):
    """Product records read back from label XML."""
    rows = label_xml.product_records(parsed(spark, sf, "records"))
    join = pipeline.join_values
    return rows.select(
        "setid", "product_name", "labeler", "dosage_form", "route", F.array_join("ndcs", "; ").alias("ndcs"),
        F.nullif(join("actives", "name", False), F.lit("")).alias("active_ingredients_raw"),
        F.nullif(join("actives", "strength", True), F.lit("")).alias("active_strength"),
        F.nullif(join("actives", "unii", True), F.lit("")).alias("active_ingredients_unii"),
        F.nullif(join("inactives", "raw_name", False), F.lit("")).alias("inactive_ingredients_raw"),
        join("inactives", "unii", False).alias("inactive_ingredients_unii"),
        "product_type",
    )


@query(
    "parsed_tiers",
    base.with_ctes(
        base.TO_PRODUCTS,
        "SELECT spl_setid, concern_tier, matched_sugar_alcohols, alternative_sugar_alcohols FROM products",
    ),
)
def parsed_tiers(spark, sf):
    """From label XML to tiered products and alternatives."""
    first = label_xml.first_label_per_archive(parsed(spark, sf, "records"))
    rows = label_xml.product_records(first)
    order = ["source_file", "member_seq", "xml_seq", "subject_seq"]
    wanted = ["spl_setid", "concern_tier", "matched_sugar_alcohols", "alternative_sugar_alcohols"]
    return pipeline.tier_products(rows, [c for c in order if c != "source_file"], columns=wanted)


# distinct on (name, unii), first one wins, as the reader does for structured ingredients
_entry_names = """
named AS (
  SELECT setid, l_partkey, pos, ing_role, raw_name, unii, strength,
    row_number() OVER (PARTITION BY setid, ing_role, lower(raw_name), coalesce(unii, '') ORDER BY pos) AS copy FROM ings
)"""
_normalized = f"CASE WHEN raw_name = lower(raw_name) AND raw_name <> upper(raw_name) THEN {base.title_case('raw_name')} ELSE raw_name END"


@query(
    "parsed_details",
    base.with_ctes(
        [base.LINES, base.RECORDS, _entry_names, f"""
        parts AS MATERIALIZED (SELECT setid, string_agg(raw_name, ', ' ORDER BY pos) FILTER (ing_role = 'inactive') AS inactive_ingredients_raw,
          string_agg({_normalized} || '/' || coalesce(unii, '') || '/' || coalesce(strength, ''), '; ' ORDER BY pos) FILTER (ing_role = 'active') AS actives,
          arg_min(strength, pos) FILTER (ing_role = 'active') AS first_strength FROM named WHERE copy = 1 GROUP BY setid)"""],
        """SELECT setid, CASE WHEN dosage_form IS NOT NULL THEN product_name || ' ' || first_strength || ' ' || dosage_form
               ELSE product_name || ' ' || first_strength END AS product_name,
             labeler, dosage_form, route, ndcs, actives, inactive_ingredients_raw FROM records JOIN parts USING (setid)""",
    ),
)
def parsed_details(spark, sf):
    """Per-subject details: extended names, ingredient entries, document fallbacks."""
    rows = label_xml.all_details(parsed(spark, sf, "details"))
    actives = F.transform(
        "active_ingredients",
        lambda e: F.concat_ws("/", e["normalized_name"], F.coalesce(e["unii"], F.lit("")), F.coalesce(e["strength"], F.lit(""))),
    )
    return rows.select(
        "setid", "product_name", "labeler", "dosage_form", "route", F.array_join("ndcs", "; ").alias("ndcs"),
        F.array_join(actives, "; ").alias("actives"), "inactive_ingredients_raw",
    )


@query(
    "parsed_section_entries",
    base.with_ctes(
        [base.LINES, """
        shown AS (SELECT setid, l_partkey % 4 AS kind, pos, raw_name, unii FROM ings WHERE ing_role = 'inactive'),
        keyed AS (SELECT *, row_number() OVER (PARTITION BY setid, CASE WHEN kind = 1 THEN raw_name ELSE lower(raw_name) END, coalesce(unii, '')
          ORDER BY pos) AS copy FROM shown)"""],
        f"""SELECT setid, raw_name AS display_name, {_normalized} AS normalized_name, coalesce(unii, '') AS unii,
              CASE WHEN kind = 0 THEN '5 mg' ELSE '' END AS strength,
              CASE kind WHEN 0 THEN concat_ws(' | ', raw_name, '5 mg', unii) WHEN 1 THEN raw_name || coalesce(' (UNII: ' || unii || ')', '') ELSE raw_name END AS raw_name,
              CASE WHEN kind = 0 THEN 'table' ELSE 'xml_structured' END AS source_type,
              CASE WHEN kind = 0 THEN 'high' ELSE 'medium' END AS confidence
            FROM keyed WHERE copy = 1
            UNION ALL
            SELECT setid, 'UNII', 'UNII', '', '', 'UNII', 'narrative_text', 'low' FROM ings GROUP BY setid, l_partkey
            HAVING l_partkey % 4 = 0 AND max(pos) <= 2""",
    ),
)
def parsed_section_entries(spark, sf):
    """Inactive ingredients by the cascade table, paragraphs, product data, narrative.

    A table of headings alone falls through to the narrative, where UNII is not a known heading.
    """
    rows = label_xml.single_details(parsed(spark, sf)).select("setid", F.explode("inactive_ingredients").alias("e"))
    return rows.select(
        "setid", "e.display_name", "e.normalized_name", F.coalesce("e.unii", F.lit("")).alias("unii"),
        F.coalesce("e.strength", F.lit("")).alias("strength"), "e.raw_name", "e.source_type", "e.confidence",
    )


# --- label versions --------------------------------------------------------------------

VERSIONS = f"""
versions AS (
  SELECT 'lab-' || source || '-' || span AS setid, CAST(v AS INTEGER) AS version, DATE '2024-01-01' + CAST(v AS INTEGER) AS published_date,
    CASE WHEN v % 7 = 6 THEN '34390-5' ELSE '34391-3' END AS doc_code, text
  FROM (SELECT source, doc_id // {derived.VERSION_SPAN} AS span, text,
          row_number() OVER (PARTITION BY source, doc_id // {derived.VERSION_SPAN} ORDER BY doc_id) - 1 AS v FROM documents) d
), sections AS (
  SELECT a.setid, a.version, s.k, s.name,
    array_to_string(list_filter(string_split(b.text, chr(10)), lambda x, i: (i - 1) % {len(derived.SECTIONS)} = s.k - 1), chr(10)) AS section_text
  FROM versions a CROSS JOIN (VALUES {', '.join(f"({k}, {base.quote(n)})" for k, n in derived.SECTIONS)}) AS s(k, name)
  JOIN versions b ON b.setid = a.setid AND b.version = a.version - a.version % (s.k + 1)
), rmc AS (
  SELECT setid, version, k, name || ' (5.' || k || ')' AS rmc_section, lpad('' || (version % 12 + 1), 2, '0') || '/2024' AS rmc_date
  FROM sections WHERE version > 0 AND (version % (k + 1) = 0 OR k = 3)
), prev AS (SELECT *, lag(version) OVER (PARTITION BY setid ORDER BY version) AS previous_version FROM versions)"""

CHANGED = """
changed AS (
  SELECT s.setid, s.version, p.previous_version, s.name, coalesce(o.section_text, '') AS old_text, s.section_text AS new_text
  FROM sections s JOIN prev p ON p.setid = s.setid AND p.version = s.version AND p.previous_version IS NOT NULL AND p.version > 1
    AND p.doc_code = '34391-3'
  LEFT JOIN sections o ON o.setid = s.setid AND o.version = p.previous_version AND o.name = s.name
  WHERE EXISTS (SELECT 1 FROM rmc r WHERE r.setid = s.setid AND r.version = s.version AND contains(r.rmc_section, s.name))
    AND coalesce(o.section_text, '') <> s.section_text
)"""


@query(
    "previous_versions",
    base.with_ctes(
        [VERSIONS],
        "SELECT setid, CAST(version AS BIGINT) AS version, CAST(previous_version AS BIGINT) AS previous_version FROM prev",
    ),
)
def previous_versions(spark, sf):
    rows = changes.with_previous_version(derived.label_versions(spark, sf).drop("text"))
    return rows.select(
        "setid", F.col("version").cast("bigint").alias("version"), F.col("previous_version").cast("bigint").alias("previous_version")
    )


@query(
    "latest_versions",
    base.with_ctes(
        [VERSIONS],
        "SELECT setid, CAST(max(version) AS BIGINT) AS version, CAST(max(published_date) AS VARCHAR) AS published FROM versions GROUP BY setid",
    ),
)
def latest_versions(spark, sf):
    from labelmill.operators.ordered import last_per_key

    rows = last_per_key(derived.label_versions(spark, sf).drop("text"), ["setid"], ["version"])
    return rows.select(
        "setid", F.col("version").cast("bigint").alias("version"), F.col("published_date").cast("string").alias("published")
    )


def _range():
    return F.lit("2024-01-10").cast("date"), F.lit("2024-02-20").cast("date")


@query(
    "change_candidates",
    base.with_ctes(
        [VERSIONS],
        """SELECT setid, CAST(version AS BIGINT) AS version FROM versions
           WHERE version > 1 AND published_date BETWEEN DATE '2024-01-10' AND DATE '2024-02-20' AND doc_code = '34391-3'""",
    ),
)
def change_candidates(spark, sf):
    rows = changes.recent_candidates(derived.label_versions(spark, sf).drop("text"), *_range())
    return changes.is_prescription(rows).select("setid", F.col("version").cast("bigint").alias("version"))


def _changed(spark, sf):
    versions = changes.with_previous_version(derived.label_versions(spark, sf).drop("text"))
    found = changes.is_prescription(versions.filter("version > 1"))
    sections = derived.label_sections(spark, sf)
    return changes.changed_sections(found, sections, derived.label_rmc(sections))


@query(
    "changed_sections",
    base.with_ctes(
        [VERSIONS, CHANGED],
        """SELECT setid, CAST(version AS BIGINT) AS version, CAST(previous_version AS BIGINT) AS previous_version, name,
             md5(old_text) AS old_hash, md5(new_text) AS new_hash FROM changed""",
    ),
)
def changed_sections(spark, sf):
    return _changed(spark, sf).select(
        "setid", F.col("version").cast("bigint").alias("version"), F.col("previous_version").cast("bigint").alias("previous_version"),
        "name", F.md5("old_text").alias("old_hash"), F.md5("new_text").alias("new_hash"),
    )


def _side(drop: str, keep: str):
    """The hash of one side's text."""
    c = F.regexp_replace("inline_html", f"<{drop}>[^<]*</{drop}>", " ")
    c = F.regexp_replace(c, f"</?{keep}>", " ")
    for safe, raw in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return F.md5(F.trim(F.regexp_replace(c, r"\s+", " ")))


@query(
    "section_diffs",
    base.with_ctes(
        [VERSIONS, CHANGED],
        f"""SELECT setid, CAST(version AS BIGINT) AS version, name, md5({base.squash('old_text')}) AS old_side, md5({base.squash('new_text')}) AS new_side
            FROM changed WHERE {base.squash('old_text')} <> '' OR {base.squash('new_text')} <> ''""",
    ),
)
def section_diffs(spark, sf):
    """Word differences; each side of the markup must give its whole text back."""
    return changes.section_diffs(_changed(spark, sf)).select(
        "setid", F.col("version").cast("bigint").alias("version"), "name",
        _side("ins", "del").alias("old_side"), _side("del", "ins").alias("new_side"),
    )


_DELETED, _INSERTED = "({n} * 7 + version) % 19 = 5", "({n} * 5 + version) % 23 = 11"


@query(
    "word_edits",
    base.with_ctes(
        [VERSIONS],
        f"""SELECT setid, CAST(version AS BIGINT) AS version, name, len(w) AS n_words, best, TRUE AS enough,
              md5(array_to_string(w, ' ')) AS old_side, md5(array_to_string(changed, ' ')) AS new_side
            FROM (SELECT *, len(list_filter(w, lambda x, i: i <> 2 AND NOT {_DELETED.format(n="(i - 1)")})) AS best,
                    list_concat(flatten(list_transform(w, lambda x, i: list_concat(
                      CASE WHEN i = 2 OR {_DELETED.format(n="(i - 1)")} THEN [] ELSE [x] END,
                      CASE WHEN {_INSERTED.format(n="(i - 1)")} THEN ['zz' || (i - 1)] ELSE [] END))), w[2:2]) AS changed
                  FROM (SELECT setid, version, name, regexp_extract_all(section_text, '\\S+') AS w FROM sections) x) y""",
    ),
)
def word_edits(spark, sf):
    """Every section against itself with words left out, marks put in and its second word moved to the end.

    All words but those left out and the moved one can stay: a difference counts as good enough if no more than two
    and a twentieth of them are lost.
    """
    sections = derived.label_sections(spark, sf)
    words = F.regexp_extract_all("section_text", F.lit(r"(\S+)"), F.lit(1))
    rows = sections.select("setid", F.col("version").cast("bigint").alias("version"), "name", words.alias("w"))
    none = F.array().cast("array<string>")
    put = lambda x, n: F.concat(
        F.when((n == 1) | ((n * 7 + F.col("version")) % 19 == 5), none).otherwise(F.array(x)),
        F.when((n * 5 + F.col("version")) % 23 == 11, F.array(F.concat(F.lit("zz"), n.cast("string")))).otherwise(none),
    )
    changed = F.concat(F.flatten(F.transform("w", put)), F.slice("w", 2, 1))
    stay = F.size(F.filter(F.transform("w", lambda x, n: (n != 1) & ((n * 7 + F.col("version")) % 19 != 5)), lambda x: x))
    joined = lambda c: F.array_join(c, " ")
    rows = rows.select("setid", "version", "name", F.size("w").alias("n_words"), stay.alias("best"), joined("w").alias("old"), joined(changed).alias("new"))
    rows = with_inline_diff(rows, "old", "new")
    return rows.select(
        "setid", "version", "name", F.col("n_words").cast("bigint").alias("n_words"), F.col("best").cast("bigint").alias("best"),
        (F.col("words_kept") + 2 >= F.col("best") * 0.95).alias("enough"),
        _side("ins", "del").alias("old_side"), _side("del", "ins").alias("new_side"),
    )


@query(
    "label_changes",
    base.with_ctes(
        [VERSIONS, CHANGED],
        """SELECT p.setid, CAST(p.version AS BIGINT) AS version, CAST(p.previous_version AS BIGINT) AS previous_version,
              CAST(p.published_date AS VARCHAR) AS published, r.n AS rmc_count, coalesce(c.n, 0) AS diff_count
            FROM (SELECT * FROM prev WHERE version > 1 AND published_date BETWEEN DATE '2024-01-10' AND DATE '2024-02-20') p
            JOIN (SELECT setid, version, count(*) AS n FROM rmc GROUP BY setid, version) r ON r.setid = p.setid AND r.version = p.version
            LEFT JOIN (SELECT setid, version, count(*) AS n FROM changed GROUP BY setid, version) c ON c.setid = p.setid AND c.version = p.version
            WHERE p.doc_code = '34391-3' AND p.previous_version IS NOT NULL""",
    ),
)
def label_changes(spark, sf):
    """The report over all candidates of the date range."""
    sections = derived.label_sections(spark, sf)
    versions = derived.label_versions(spark, sf).drop("text")
    rows = changes.label_changes(versions, sections, derived.label_rmc(sections), *_range())
    return rows.select(
        "setid", F.col("version").cast("bigint").alias("version"), F.col("previous_version").cast("bigint").alias("previous_version"),
        F.col("published_date").cast("string").alias("published"), "rmc_count", "diff_count",
    )


@query(
    "recent_listed_changes",
    base.with_ctes(
        [VERSIONS],
        """SELECT setid, CAST(version AS BIGINT) AS version, rmc_section, rmc_date FROM rmc
           WHERE strptime('01/' || rmc_date, '%d/%m/%Y') >= DATE '2024-06-15'""",
    ),
)
def recent_listed_changes(spark, sf):
    rows = derived.label_rmc(derived.label_sections(spark, sf))
    rows = rows.filter(changes.is_recent(F.col("rmc_date"), F.lit("2024-06-15").cast("date")))
    return rows.select("setid", F.col("version").cast("bigint").alias("version"), "rmc_section", "rmc_date")


def _read_sections(spark, sf):
    docs = label_xml.parse_documents(derived.change_documents(spark, sf).drop("published_date"))
    return changes.known_sections(docs)


@query(
    "document_sections",
    base.with_ctes(
        [VERSIONS],
        f"""SELECT setid, CAST(version AS BIGINT) AS version, name, md5({base.squash('section_text')}) AS lines FROM sections
            WHERE {base.squash('section_text')} <> ''""",
    ),
)
def document_sections(spark, sf):
    """Known sections read from version XML, whole texts."""
    rows = _read_sections(spark, sf).filter(F.col("name") != vocab.CHANGES_SECTION)
    return rows.select(
        "setid", F.col("version").cast("bigint").alias("version"), "name", F.md5(F.array_join("lines", " ")).alias("lines")
    )


@query(
    "document_changes",
    base.with_ctes([VERSIONS], "SELECT setid, CAST(version AS BIGINT) AS version, rmc_section, rmc_date FROM rmc"),
)
def document_changes(spark, sf):
    """Section and date pairs of the changes tables in version XML."""
    rows = changes.listed_changes(_read_sections(spark, sf), ["setid", "version"])
    return rows.withColumn("version", F.col("version").cast("bigint"))
