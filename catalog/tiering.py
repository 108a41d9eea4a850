"""Queries over tiering, promotion, quality reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import base
from labelmill import vocab
from labelmill.functions import text
from labelmill.operators import classify, match
from labelmill.operators.ordered import first_per_key
from labelmill.plans import pipeline, quality
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


def records(spark: SparkSession, sf: str) -> DataFrame:
    return derived.label_records(spark, sf)


def assessed(spark: SparkSession, sf: str) -> DataFrame:
    return pipeline.assess(records(spark, sf))


def products(spark: SparkSession, sf: str) -> DataFrame:
    return pipeline.tier_products(records(spark, sf))


def stored(spark: SparkSession, sf: str) -> DataFrame:
    """Products with the excluded rows kept for debugging."""
    return pipeline.tiered_rows(assessed(spark, sf), include_excluded=True)


CLASS_COLUMNS = [
    "setid", "dosage_form", "route", "form_class", "route_class", "included_form_match", "excluded_form_match",
    "included_route_match", "excluded_route_match",
]
PRODUCT_COLUMNS = [
    "spl_setid", "product_name", "labeler", "dosage_form", "normalized_form", "form_class", "route", "normalized_route",
    "route_class", "ndcs", "active_ingredients_raw", "active_strength", "active_ingredients_unii", "concern_tier",
    "inclusion_decision", "review_reason", "included_form_match", "excluded_form_match", "included_route_match",
    "excluded_route_match", "inactive_ingredients_raw", "inactive_ingredients_unii", "matched_sugar_alcohols",
    "matched_sugar_alcohol_terms", "matched_sugar_alcohol_uniis", "source_file",
]


@query(
    "label_records",
    base.with_ctes(
        [base.LINES, base.RECORDS],
        """SELECT setid, source_file, product_name, labeler, dosage_form, route, product_type, ndcs,
             CAST(n_active AS BIGINT) AS n_active, CAST(n_inactive AS BIGINT) AS n_inactive
           FROM records JOIN (SELECT setid, count(*) FILTER (ing_role = 'active') AS n_active,
             count(*) FILTER (ing_role = 'inactive') AS n_inactive FROM ings GROUP BY setid) c USING (setid)""",
    ),
)
def label_records(spark, sf):
    return records(spark, sf).select(
        "setid", "source_file", "product_name", "labeler", "dosage_form", "route", "product_type",
        F.array_join("ndcs", "; ").alias("ndcs"),
        F.size("actives").cast("bigint").alias("n_active"),
        F.size("inactives").cast("bigint").alias("n_inactive"),
    )


@query(
    "form_route_classes",
    base.with_ctes(
        [base.LINES, base.RECORDS, base.CLASSED],
        f"SELECT {', '.join(CLASS_COLUMNS)}, CAST(should_process AS INTEGER) AS should_process, "
        "CAST(is_human AS INTEGER) AS is_human FROM classed",
    ),
)
def form_route_classes(spark, sf):
    out = classify.classify_form_and_route(records(spark, sf)).withColumn("is_human", classify.is_human())
    return out.select(
        *CLASS_COLUMNS,
        F.col("should_process").cast("int").alias("should_process"),
        F.col("is_human").cast("int").alias("is_human"),
    )


@query(
    "concept_matches",
    base.with_ctes(
        [base.LINES, base.hits("pipeline")],
        "SELECT setid, concept AS canonical_name, category, raw_name, unii FROM hits",
    ),
)
def concept_matches(spark, sf):
    rows = records(spark, sf).select("setid", F.explode(match.match_concepts(F.col("inactives"))).alias("m"))
    return rows.select(
        "setid", "m.canonical_name", "m.category", "m.raw_name", F.coalesce("m.unii", F.lit("")).alias("unii")
    )


@query(
    "concept_matches_app",
    base.with_ctes(
        [base.LINES, base.hits("app")],
        "SELECT setid, concept AS canonical_name, category AS risk_level, term AS matched_term FROM hits",
    ),
)
def concept_matches_app(spark, sf):
    rows = records(spark, sf).select("setid", F.explode(match.match_concepts(F.col("inactives"), "app")).alias("m"))
    return rows.select("setid", "m.canonical_name", F.col("m.category").alias("risk_level"), "m.matched_term")


@query(
    "alias_table_matches",
    base.with_ctes(
        [base.LINES, base.hits("pipeline")],
        "SELECT setid, concept AS canonical_name, CAST(pos AS BIGINT) AS pos, raw_name, unii FROM hits",
    ),
)
def alias_table_matches(spark, sf):
    """Set form of concept matching with the aliases as a table."""
    pairs = [(c, a) for c, aliases in vocab.PIPELINE_CONCEPTS.items() for a in aliases]
    aliases = spark.createDataFrame(pairs, "canonical_name string, alias string")
    flat = derived.label_ingredients(spark, sf).filter("ing_role = 'inactive'")
    out = match.match_alias_table(flat, aliases)
    return out.select(
        "setid", "canonical_name", F.col("pos").cast("bigint").alias("pos"), "raw_name",
        F.coalesce("unii", F.lit("")).alias("unii"),
    )


@query(
    "tier_decisions",
    base.with_ctes(
        base.TO_ASSESSED,
        "SELECT setid, concern_tier, review_reason, names AS matched_sugar_alcohols, exclusion_reason FROM assessed",
    ),
)
def tier_decisions(spark, sf):
    return assessed(spark, sf).select(
        "setid", "concern_tier", "review_reason",
        pipeline.join_values("matched", "canonical_name", False).alias("matched_sugar_alcohols"), "exclusion_reason",
    )


@query(
    "tier_decisions_app",
    base.with_ctes(
        base.TO_ASSESSED_APP,
        """SELECT setid, concern_tier, review_reason, names AS matched_sugar_alcohols, terms AS matched_terms,
          concat_ws(' | ', 'form:' || included_form_match, 'route:' || included_route_match,
            CASE WHEN names <> '' THEN 'sugar_alcohols:' || replace(names, '; ', ',') END) AS inclusion_reasons,
          concat_ws(' | ', 'form:' || excluded_form_match, 'route:' || excluded_route_match,
            CASE WHEN names = '' AND concern_tier = 'excluded' THEN 'no_sugar_alcohol_found' END) AS exclusion_reasons
        FROM assessed""",
    ),
)
def tier_decisions_app(spark, sf):
    rows = pipeline.assess(records(spark, sf), "app").withColumns(classify.decision_reasons())
    return rows.select(
        "setid", "concern_tier", "review_reason",
        pipeline.join_values("matched", "canonical_name", False).alias("matched_sugar_alcohols"),
        pipeline.join_values("matched", "matched_term", False).alias("matched_terms"),
        F.array_join("inclusion_reasons", " | ").alias("inclusion_reasons"),
        F.array_join("exclusion_reasons", " | ").alias("exclusion_reasons"),
    )


@query(
    "tiered_products",
    base.with_ctes(
        base.TO_PRODUCTS, f"SELECT {', '.join(PRODUCT_COLUMNS)}, alternative_sugar_alcohols FROM products"
    ),
)
def tiered_products(spark, sf):
    """Flagship: tiered products and the alternatives that avoid sugar alcohols."""
    return products(spark, sf).select(*PRODUCT_COLUMNS, "alternative_sugar_alcohols")


@query(
    "alternatives",
    base.with_ctes(base.TO_PRODUCTS, "SELECT spl_setid, alternative_sugar_alcohols FROM promoted"),
)
def alternatives(spark, sf):
    rows = pipeline.product_rows(assessed(spark, sf), ["subject_seq"]).select(*pipeline.PROMOTION, "subject_seq")
    rows = stage(rows, "assessed", ["concern_tier"])
    candidates = pipeline.liquid_candidates(rows, ["subject_seq"])
    return pipeline.alternatives(rows, candidates).select(
        "spl_setid", "alternative_sugar_alcohols"
    )


@query(
    "substance_concepts",
    base.with_ctes(
        base.TO_PRODUCTS,
        "SELECT unii, string_agg(name, '; ' ORDER BY name) AS names FROM avoid GROUP BY unii",
    ),
)
def substance_concepts(spark, sf):
    tiered = pipeline.tiered_rows(assessed(spark, sf))
    flat = tiered.select(
        F.explode(text.split_list(F.col("active_ingredients_unii"))).alias("unii"),
        text.split_list(F.col("matched_sugar_alcohols")).alias("names"),
    )
    return (
        flat.select("unii", F.explode("names").alias("name"))
        .groupBy("unii")
        .agg(F.array_join(F.array_sort(F.collect_set("name")), "; ").alias("names"))
    )


@query(
    "matched_excipients",
    base.with_ctes(
        base.TO_ASSESSED,
        """SELECT setid AS spl_setid, h.raw_name, lower(h.raw_name) AS normalized_name, h.concept AS canonical_name, h.category,
             h.unii FROM hits h JOIN assessed a USING (setid) WHERE is_human AND concern_tier <> 'excluded'""",
    ),
)
def matched_excipients(spark, sf):
    return pipeline.matched_excipients(assessed(spark, sf)).na.fill("", ["unii"])


PART_LABEL = "'set-' || seq"
_resubmitted = [
    *base.TO_STORED,
    f"""ranked AS (SELECT s.*, {PART_LABEL} AS label_id,
          row_number() OVER (PARTITION BY seq ORDER BY spl_setid DESC) AS from_last,
          row_number() OVER (PARTITION BY seq ORDER BY spl_setid) AS from_first FROM stored s
        WHERE concern_tier <> 'excluded')""",
]


@query(
    "last_write_wins",
    base.with_ctes(
        _resubmitted,
        "SELECT label_id AS spl_setid, labeler, concern_tier, matched_sugar_alcohols FROM ranked WHERE from_last = 1",
    ),
)
def last_write_wins(spark, sf):
    """All labels of a part as subjects of one label: the last included one is stored."""
    rows = records(spark, sf).withColumn("write_seq", F.col("setid"))
    rows = rows.withColumn("setid", F.concat(F.lit("set-"), F.col("seq").cast("string")))
    tiered = pipeline.tiered_rows(pipeline.assess(rows), ["write_seq"])
    return pipeline.upsert_products(tiered, ["write_seq"]).select(
        "spl_setid", "labeler", "concern_tier", "matched_sugar_alcohols"
    )


@query(
    "first_candidate_wins",
    base.with_ctes(
        [*base.TO_STORED, f"""ranked AS (SELECT *, {PART_LABEL} AS label_id,
           row_number() OVER (PARTITION BY seq ORDER BY spl_setid) AS rn FROM stored
           WHERE concern_tier = 'excluded' AND should_process AND active_ingredients_unii IS NOT NULL)"""],
        "SELECT label_id AS spl_setid, labeler, active_ingredients_unii, inactive_ingredients_raw FROM ranked WHERE rn = 1",
    ),
)
def first_candidate_wins(spark, sf):
    rows = records(spark, sf).withColumn("write_seq", F.col("setid"))
    rows = rows.withColumn("setid", F.concat(F.lit("set-"), F.col("seq").cast("string")))
    return pipeline.liquid_candidates(pipeline.product_rows(pipeline.assess(rows), ["write_seq"]), ["write_seq"]).select(
        "spl_setid", "labeler", "active_ingredients_unii", "inactive_ingredients_raw"
    )


@query(
    "multi_subject_alternatives",
    base.with_ctes(
        [
            *_resubmitted,
            f"""last_rows AS (SELECT * REPLACE (label_id AS spl_setid) FROM ranked WHERE from_last = 1),
            cands AS (SELECT * FROM (SELECT * REPLACE ({PART_LABEL} AS spl_setid),
               row_number() OVER (PARTITION BY seq ORDER BY spl_setid) AS rn FROM stored
               WHERE concern_tier = 'excluded' AND should_process AND active_ingredients_unii IS NOT NULL) q WHERE rn = 1),
            avoid AS (SELECT DISTINCT u AS unii, n AS name FROM (
               SELECT unnest(string_split(active_ingredients_unii, '; ')) AS u, matched_sugar_alcohols AS m FROM last_rows
               WHERE active_ingredients_unii IS NOT NULL) q, unnest(string_split(m, '; ')) AS s(n)),
            free AS (SELECT c.* FROM cands c WHERE NOT EXISTS (SELECT 1 FROM last_rows t
               WHERE lower(t.product_name) = lower(c.product_name) AND lower(t.labeler) = lower(c.labeler))),
            shared AS (SELECT spl_setid, string_agg(DISTINCT name, '; ' ORDER BY name) AS alternative_sugar_alcohols
               FROM (SELECT spl_setid, unnest(string_split(active_ingredients_unii, '; ')) AS unii FROM free) f
               JOIN avoid USING (unii) GROUP BY spl_setid)""",
        ],
        """SELECT spl_setid, concern_tier, NULL AS alternative_sugar_alcohols FROM last_rows
           UNION ALL SELECT spl_setid, 'alternative', alternative_sugar_alcohols FROM shared
           WHERE spl_setid NOT IN (SELECT spl_setid FROM last_rows)""",
    ),
)
def multi_subject_alternatives(spark, sf):
    """A label with a matched and an unmatched subject never becomes an alternative."""
    rows = records(spark, sf).withColumn("write_seq", F.col("setid"))
    rows = rows.withColumn("setid", F.concat(F.lit("set-"), F.col("seq").cast("string")))
    return pipeline.tier_products(rows, ["write_seq"], columns=["spl_setid", "concern_tier", "alternative_sugar_alcohols"])


@query(
    "archive_duplicates",
    base.with_ctes(
        [base.LINES, base.RECORDS],
        """SELECT source_file, 'set-' || seq AS setid, min(setid) AS kept, CAST(count(*) AS BIGINT) AS copies
           FROM records GROUP BY source_file, seq""",
    ),
)
def archive_duplicates(spark, sf):
    """First label per (archive, setid); the copies are counted before they go."""
    rows = records(spark, sf).select(
        "source_file", F.concat(F.lit("set-"), F.col("seq").cast("string")).alias("label_id"), "setid"
    )
    first = first_per_key(rows, ["source_file", "label_id"], [F.col("setid")])
    copies = rows.groupBy("source_file", "label_id").agg(F.count(F.lit(1)).alias("copies"))
    return first.join(copies, ["source_file", "label_id"]).select(
        "source_file", F.col("label_id").alias("setid"), F.col("setid").alias("kept"), "copies"
    )


@query(
    "broad_recall",
    base.with_ctes(
        base.TO_STORED,
        """SELECT spl_setid, product_name, coalesce(labeler, '') AS labeler, coalesce(dosage_form, '') AS dosage_form,
             coalesce(route, '') AS route, form_class, route_class, matched_sugar_alcohols, matched_sugar_alcohol_terms,
             concern_tier, CASE WHEN concern_tier <> 'excluded' THEN 'True' ELSE 'False' END AS in_strict_output, source_file
           FROM stored WHERE should_process""",
    ),
)
def broad_recall(spark, sf):
    return pipeline.broad_recall(assessed(spark, sf))


@query(
    "excluded_audit",
    base.with_ctes(
        base.TO_ASSESSED,
        """SELECT setid AS spl_setid, product_name, dosage_form, route, CASE WHEN is_human THEN form_class ELSE '' END AS form_class,
             CASE WHEN is_human THEN route_class ELSE '' END AS route_class, exclusion_reason,
             raws AS matched_sugar_alcohol_terms, source_file
           FROM assessed WHERE exclusion_reason IS NOT NULL""",
    ),
)
def excluded_audit(spark, sf):
    return pipeline.excluded_audit(assessed(spark, sf)).drop("review_reason")


@query(
    "archive_log",
    base.with_ctes(
        base.TO_ASSESSED,
        """SELECT source_file, high, moderate, review, excluded, spls, CAST(0 AS BIGINT) AS parse_errors,
             'high=' || high || ', moderate=' || moderate || ', review=' || review || ', excluded=' || excluded ||
             ', spls=' || spls || ', parse_errors=0' AS message
           FROM (SELECT source_file, count(*) FILTER (is_human AND concern_tier = 'high') AS high,
             count(*) FILTER (is_human AND concern_tier = 'moderate') AS moderate,
             count(*) FILTER (is_human AND concern_tier = 'review') AS review,
             count(*) FILTER (is_human AND concern_tier = 'excluded') AS excluded, count(DISTINCT setid) AS spls
             FROM assessed GROUP BY source_file) q""",
    ),
)
def archive_log(spark, sf):
    rows = assessed(spark, sf)
    unread = rows.filter(F.size("actives") + F.size("inactives") == 0)
    return pipeline.archive_log(rows, unread)


@query(
    "pending_archives",
    base.with_ctes(
        base.TO_ASSESSED,
        """SELECT DISTINCT source_file FROM records WHERE source_file NOT IN (
             SELECT source_file FROM assessed GROUP BY source_file
             HAVING count(*) FILTER (is_human AND concern_tier = 'review') % 2 = 0)""",
    ),
)
def pending_archives(spark, sf):
    """Archives still to do; those with an even review count are logged as done."""
    rows = assessed(spark, sf)
    review = F.count_if(F.col("is_human") & (F.col("concern_tier") == "review"))
    log = rows.groupBy("source_file").agg(F.when(review % 2 == 0, "success").otherwise("failed").alias("status"))
    return pipeline.pending_archives(rows.select("source_file").distinct(), log)


# --- quality reports --------------------------------------------------------------

COUNT = "CAST(count(*) AS BIGINT)"


@query(
    "tier_counts",
    base.with_ctes(
        base.TO_PRODUCTS, f"SELECT concern_tier, {COUNT} AS product_count FROM products GROUP BY concern_tier"
    ),
)
def tier_counts(spark, sf):
    return quality.tier_counts(products(spark, sf))


@query(
    "class_summaries",
    base.with_ctes(
        base.TO_STORED,
        f"""SELECT 'form' AS dimension, form_class AS class, concern_tier, {COUNT} AS count FROM stored GROUP BY 2, 3
            UNION ALL SELECT 'route', route_class, concern_tier, {COUNT} FROM stored GROUP BY 2, 3""",
    ),
)
def class_summaries(spark, sf):
    return quality.class_summaries(stored(spark, sf))


@query(
    "form_summary",
    base.with_ctes(
        base.TO_PRODUCTS, f"SELECT form_class, concern_tier, {COUNT} AS count FROM products GROUP BY 1, 2"
    ),
)
def form_summary(spark, sf):
    return quality.form_summary(products(spark, sf))


@query(
    "route_summary",
    base.with_ctes(
        base.TO_PRODUCTS, f"SELECT route_class, concern_tier, {COUNT} AS count FROM products GROUP BY 1, 2"
    ),
)
def route_summary(spark, sf):
    return quality.route_summary(products(spark, sf))


@query(
    "excipient_summary",
    base.with_ctes(
        base.TO_PRODUCTS,
        f"""SELECT canonical_name, CAST(count(spl_setid) AS BIGINT) AS product_count
            FROM (VALUES {', '.join(f"({base.quote(c)})" for c in vocab.PIPELINE_CONCEPTS)}) v(canonical_name)
            LEFT JOIN products ON inclusion_decision = 'included' AND matched_sugar_alcohols LIKE '%' || canonical_name || '%'
            GROUP BY canonical_name""",
    ),
)
def excipient_summary(spark, sf):
    return quality.excipient_summary(products(spark, sf))


_record_sql = {
    "total_records": "true",
    "non_human_skipped": "NOT is_human",
    "with_dosage_form": "is_human AND coalesce(dosage_form, '') <> ''",
    "strong_liquid_form": "is_human AND form_class = 'strong'",
    "ambiguous_form": "is_human AND form_class = 'ambiguous'",
    "excluded_form": "is_human AND form_class = 'excluded'",
    "non_liquid_form": "is_human AND form_class = 'non_liquid'",
    "with_route": "is_human AND coalesce(route, '') <> ''",
    "allowed_route": "is_human AND route_class = 'oral'",
    "excluded_route": "is_human AND route_class = 'excluded'",
    "blank_route": "is_human AND route_class = 'blank'",
    "with_inactive_ingredients": "is_human AND should_process AND setid IN (SELECT setid FROM ings WHERE pos > 2)",
    "with_sugar_alcohol_hit": "is_human AND should_process AND names <> ''",
    "final_high": "is_human AND concern_tier = 'high'",
    "final_moderate": "is_human AND concern_tier = 'moderate'",
    "final_review": "is_human AND concern_tier = 'review'",
    "final_excluded": "is_human AND concern_tier = 'excluded'",
}
_stage_arms = [
    "SELECT 'total_xml_files' AS stage, count(*) AS count FROM documents",
    "SELECT 'parse_successes', count(*) FILTER (n_chars > 0) FROM documents",
    "SELECT 'parse_failures', count(*) FILTER (NOT n_chars > 0) FROM documents",
] + [f"SELECT {base.quote(n)}, count(*) FILTER ({c}) FROM assessed" for n, c in _record_sql.items()]


@query("funnel", base.with_ctes(base.TO_ASSESSED, " UNION ALL ".join(_stage_arms)))
def funnel(spark, sf):
    read = derived.table(spark, sf, "documents").select((F.col("n_chars") > 0).alias("parsed"))
    return quality.funnel(assessed(spark, sf), read)


_wide = ", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in _record_sql.items())


@query(
    "archive_funnel",
    base.with_ctes(
        base.TO_ASSESSED, f"SELECT source_file, {_wide} FROM assessed GROUP BY ROLLUP (source_file)"
    ),
)
def archive_funnel(spark, sf):
    return quality.archive_funnel(assessed(spark, sf))


@query(
    "qa_samples",
    base.with_ctes(
        base.TO_STORED,
        f"""SELECT bucket, spl_setid, concern_tier, inclusion_decision FROM (
              SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5('0|' || spl_setid), spl_setid) AS rn
              FROM stored JOIN (VALUES ('included'), ('review'), ('excluded')) b(bucket)
                ON concern_tier = bucket OR inclusion_decision = bucket) q WHERE rn <= {vocab.SAMPLE_SIZE}""",
    ),
)
def qa_samples(spark, sf):
    return quality.samples(stored(spark, sf)).select("bucket", "spl_setid", "concern_tier", "inclusion_decision")


_expected_sql = """
expected AS (
  SELECT CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'X ' || p_name || '!' END AS expected_product_name,
    CASE WHEN p_partkey % 2 = 0 THEN 'set-' || p_partkey || '-0-0' ELSE '' END AS expected_setid,
    split_part('Sorbitol|mannitol||XYLITOL', '|', CAST(p_partkey % 4 + 1 AS INTEGER)) AS expected_excipient,
    split_part('Included|high|moderate||review', '|', CAST(p_partkey % 5 + 1 AS INTEGER)) AS expected_decision,
    'part ' || p_partkey AS notes FROM part
)"""


@query(
    "known_positives",
    base.with_ctes(
        [
            *base.TO_PRODUCTS,
            _expected_sql.replace("'X ' || p_name", "'  ' || upper(p_name)"),
            f"""found AS (
              SELECT e.*, p.spl_setid, p.concern_tier, p.inclusion_decision, p.matched_sugar_alcohols,
                row_number() OVER (PARTITION BY e.notes ORDER BY p.seq, p.spl_setid) AS rn
              FROM expected e LEFT JOIN products p ON (e.expected_setid <> '' AND p.spl_setid = e.expected_setid)
                OR (e.expected_setid = '' AND {base.normalize_text('p.product_name')} = {base.normalize_text('e.expected_product_name')}))""",
        ],
        """SELECT trim(expected_product_name) AS expected_product_name, expected_setid, expected_excipient, expected_decision, notes,
             CASE WHEN spl_setid IS NULL THEN 'MISSING'
                  WHEN expected_excipient <> '' AND NOT contains(matched_sugar_alcohols, lower(expected_excipient)) THEN 'FAIL_EXCIPIENT'
                  WHEN expected_decision <> '' AND lower(expected_decision) NOT IN (inclusion_decision, concern_tier) THEN 'FAIL_TIER'
                  ELSE 'PASS' END AS outcome,
             coalesce(spl_setid, '') AS found_setid, coalesce(inclusion_decision, '') AS found_decision,
             coalesce(matched_sugar_alcohols, '') AS found_excipients
           FROM found WHERE rn = 1""",
    ),
)
def known_positives(spark, sf):
    return quality.known_positive_outcomes(_expected(spark, sf), _sequenced_products(spark, sf), ["seq"])


def _expected(spark, sf):
    p = F.col("p_partkey")
    part = derived.table(spark, sf, "part").select("p_partkey", "p_name")
    return part.select(
        F.when(p % 2 == 0, "").otherwise(F.concat(F.upper("p_name"), F.lit("!"))).alias("expected_product_name"),
        F.when(p % 2 == 0, F.concat(F.lit("set-"), p.cast("string"), F.lit("-0-0"))).otherwise("").alias("expected_setid"),
        F.split_part(F.lit("Sorbitol|mannitol||XYLITOL"), F.lit("|"), (p % 4 + 1).cast("int")).alias("expected_excipient"),
        F.split_part(F.lit("Included|high|moderate||review"), F.lit("|"), (p % 5 + 1).cast("int")).alias("expected_decision"),
        F.concat(F.lit("part "), p.cast("string")).alias("notes"),
    )


def _sequenced_products(spark, sf):
    seq = F.split_part("spl_setid", F.lit("-"), F.lit(2)).cast("bigint")
    return products(spark, sf).withColumn("seq", seq)


@query(
    "known_positive_totals",
    f"SELECT count(*) FILTER (outcome = 'PASS') AS passes, count(*) AS total FROM ({ORACLES['known_positives']}) k",
)
def known_positive_totals(spark, sf):
    return quality.outcome_totals(known_positives(spark, sf))


_form = "lower(dosage_form)"
_expected_form = f"""CASE WHEN {base.any_contained(_form, vocab.EXCLUDED_FORMS)} THEN 'excluded' WHEN {base.any_contained(_form, vocab.STRONG_FORMS)} THEN 'strong'
  WHEN {base.any_contained(_form, vocab.AMBIGUOUS_FORMS)} THEN 'ambiguous' ELSE 'non_liquid' END"""


def _checked(spark, sf):
    """Every product's form as a case: the class by plain word lists against the classifier's."""
    rows = classify.classify_form_and_route(records(spark, sf)).withColumn("expected", F.expr(_expected_form))
    return quality.check_cases(rows, "expected", "form_class")


@query(
    "static_checks",
    base.with_ctes([base.LINES, base.RECORDS, base.CLASSED], "SELECT setid, form_class AS expected, 'PASS' AS result FROM classed"),
)
def static_checks(spark, sf):
    return _checked(spark, sf).select("setid", "expected", "result")


@query("checks_passed", base.with_ctes([base.LINES, base.RECORDS, base.CLASSED], "SELECT count(*) > 0 AS all_passed FROM classed"))
def checks_passed(spark, sf):
    return quality.all_passed(_checked(spark, sf))

