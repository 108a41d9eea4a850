"""Queries over text expressions and narrative ingredient parsing, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import base
from labelmill import vocab
from labelmill.functions import ingredients, text
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


@query(
    "normalized_texts",
    f"SELECT doc_id, md5({base.normalize_text('text')}) AS normalized, md5({base.squash('lower(text)')}) AS simple FROM documents",
)
def normalized_texts(spark, sf):
    docs = derived.table(spark, sf, "documents")
    return docs.select(
        "doc_id",
        F.md5(text.normalize_text(F.col("text"))).alias("normalized"),
        F.md5(text.normalize_simple(F.col("text"))).alias("simple"),
    )


def _excipient_sql(x: str) -> str:
    x = f"lower({x})"
    for old, new in (("&", " and "), ("#", " no "), ("_", " "), ("-", " ")):
        x = f"replace({x}, '{old}', '{new}')"
    x = f"regexp_replace({x}, '\\b(?:number|no)\\.?\\b', ' no ', 'g')"
    x = base.squash(f"regexp_replace({x}, '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g')")
    for pattern, new in vocab.CANONICAL_REWRITES:
        x = f"regexp_replace({x}, '{pattern}', '{new}', 'g')"
    return base.squash(x)


_names_sql = """
names AS (
  SELECT DISTINCT raw_name AS name FROM ings
  UNION SELECT DISTINCT replace(raw_name, 'FD&C', 'fd and c') || ' aluminum lake' FROM ings
  UNION SELECT DISTINCT 'D - ' || lower(raw_name) || ' #' || l_partkey % 7 FROM ings
)"""


def _names(spark, sf):
    raw = derived.label_lines(spark, sf).select("raw_name", "l_partkey").distinct()
    lake = F.concat(F.replace("raw_name", F.lit("FD&C"), F.lit("fd and c")), F.lit(" aluminum lake"))
    numbered = F.concat(F.lit("D - "), F.lower("raw_name"), F.lit(" #"), (F.col("l_partkey") % 7).cast("string"))
    return raw.select(F.explode(F.array(F.col("raw_name"), lake, numbered)).alias("name")).distinct()


@query(
    "excipient_names",
    base.with_ctes([base.LINES, _names_sql], f"SELECT name, {_excipient_sql('name')} AS canonical FROM names"),
)
def excipient_names(spark, sf):
    return _names(spark, sf).select("name", text.normalize_excipient(F.col("name")).alias("canonical"))


_phrases = ", ".join(
    f"CASE WHEN contains(c, '{p}') THEN nullif({base.squash(f'''replace(c, '{p}', ' ')''')}, '') END" for p in vocab.REMOVABLE_PHRASES
)
_dye = "'^(?:(?:fdc|dc)\\s+)?(red|yellow|blue|green|orange|violet)\\s+(?:dye\\s+)?no\\s+([a-z0-9]+)(?:\\s+aluminum\\s+lake)?$'"


@query(
    "excipient_match_keys",
    base.with_ctes(
        [base.LINES, _names_sql, f"canon AS (SELECT name, {_excipient_sql('name')} AS c FROM names)",
         f"dyes AS (SELECT *, regexp_extract(c, {_dye}, 1) AS color, regexp_extract(c, {_dye}, 2) AS num FROM canon)"],
        f"""SELECT DISTINCT name, k AS match_key FROM (SELECT name, unnest([nullif(c, ''), {_phrases},
              CASE WHEN starts_with(c, 'peg ') THEN 'peg' END, CASE WHEN starts_with(c, 'sorbitol solution') THEN 'sorbitol' END,
              CASE WHEN color <> '' THEN color || ' no ' || num END, CASE WHEN color <> '' THEN color || ' dye ' || num END,
              CASE WHEN color <> '' THEN color || ' dye' END,
              CASE WHEN regexp_full_match(upper(regexp_replace(name, '\\s+', '', 'g')), '[A-Z0-9]{{10}}')
                THEN upper(regexp_replace(name, '\\s+', '', 'g')) END]) AS k FROM dyes) x WHERE k IS NOT NULL""",
    ),
)
def excipient_match_keys(spark, sf):
    rows = _names(spark, sf)
    return rows.select("name", F.explode(ingredients.match_keys(F.col("name"), broaden=True)).alias("match_key"))


_spellings = "upper({n}) || ' solution'", "lower({n})"


@query(
    "ingredient_keys",
    base.with_ctes(
        [base.LINES, _names_sql,
         f"spelled AS (SELECT DISTINCT unnest([name, {', '.join(x.format(n='name') for x in _spellings)}]) AS name FROM names)",
         f"canon AS (SELECT name, {_excipient_sql('name')} AS c FROM spelled)",
         f"dyes AS (SELECT *, regexp_extract(c, {_dye}, 1) AS color, regexp_extract(c, {_dye}, 2) AS num FROM canon)",
         f"""keys AS (SELECT DISTINCT name, k FROM (SELECT name, unnest([nullif(c, ''), {_phrases},
              CASE WHEN starts_with(c, 'peg ') THEN 'peg' END, CASE WHEN starts_with(c, 'sorbitol solution') THEN 'sorbitol' END,
              CASE WHEN color <> '' THEN color || ' no ' || num END, CASE WHEN color <> '' THEN color || ' dye ' || num END,
              CASE WHEN color <> '' THEN color || ' dye' END,
              CASE WHEN regexp_full_match(upper(regexp_replace(name, '\\s+', '', 'g')), '[A-Z0-9]{{10}}')
                THEN upper(regexp_replace(name, '\\s+', '', 'g')) END]) AS k FROM dyes) x WHERE k IS NOT NULL)""",
         f"asked AS (SELECT DISTINCT name, unnest([name, {', '.join(x.format(n='name') for x in _spellings)}]) AS spelling FROM names)"],
        """SELECT a.name, k AS match_key FROM asked a JOIN keys ON keys.name = a.spelling
           UNION SELECT name, upper(substr(md5(name), 1, 10)) FROM names WHERE name IS NOT NULL""",
    ),
)
def ingredient_keys(spark, sf):
    """Keys of an ingredient by its three spellings and its code."""
    display, normalized = (F.expr(x.format(n="name")) for x in _spellings)
    rows = _names(spark, sf)
    keys = ingredients.ingredient_keys(F.col("name"), display, normalized, F.substring(F.md5("name"), 1, 10))
    return rows.select("name", F.explode(keys).alias("match_key")).distinct()


# --- narrative ingredient parsing ---------------------------------------------------


def _protect(x: str) -> str:
    """Commas whose next bracket is a closing one become chr(1), last one first."""
    for _ in range(12):
        x = f"regexp_replace({x}, ',([^(),]*\\))', chr(1) || '\\1', 'g')"
    return x


def _edge(x: str) -> str:
    return f"trim({x}, ' ,;:')"


_chunks = f"""
chunks AS (
  SELECT doc_id, chunk, ci FROM (SELECT doc_id, unnest(parts) AS chunk, generate_subscripts(parts, 1) AS ci FROM (
    SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(replace(text, chr(13), chr(10)), chr(9), chr(10)), '[;\\n]+'),
      lambda c: regexp_replace(c, '^\\s+|\\s+$', '', 'g')), lambda c: c <> '') AS parts FROM documents) a) b
), pieces AS (
  SELECT doc_id, ci, unnest(ps) AS piece, generate_subscripts(ps, 1) AS pi FROM (
    SELECT doc_id, ci, CASE WHEN contains(lower(chunk), 'unii') OR len(ps) <= 1 THEN [chunk] ELSE ps END AS ps FROM (
      SELECT *, list_filter(list_transform(string_split({_protect('chunk')}, ','),
        lambda p: regexp_replace(replace(p, chr(1), ','), '^\\s+|\\s+$', '', 'g')), lambda p: p <> '') AS ps FROM chunks) c) d
)"""
_headers = ", ".join(base.quote(h) for h in vocab.HEADER_LINES)
_label_pattern = "'^(?:inactive ingredients?|active ingredients?|contains)\\s*:\\s*'"
_units = "(?:mg|mcg|g|kg|mL|ml|L|%)"
_cleaned = f"""
cleaned AS (
  SELECT *, CASE WHEN regexp_full_match(bare, '[0-9]+') OR bare = '' OR lower(bare) IN ({_headers}) OR lower(col) IN ({_headers})
    THEN NULL ELSE bare END AS name FROM (
    SELECT *, {_edge(base.squash(f"regexp_replace({_edge(f'''regexp_replace(col, '\\s+[0-9]+(?:\\.[0-9]+)?\\s*{_units}\\b.*$', '', 'i')''')}, '\\(UNII:\\s*([A-Z0-9]+)\\)', '', 'gi')"))} AS bare
    FROM (SELECT *, {_edge(f"regexp_replace({_edge(base.squash('piece'))}, {_label_pattern}, '', 'i')")} AS col FROM pieces) e) f
)"""


@query(
    "narrative_ingredients",
    base.with_ctes(
        [_chunks, _cleaned],
        f"""SELECT doc_id, name AS display_name, md5(arg_min({base.squash('piece')}, (ci, pi))) AS raw_name,
              min(CASE WHEN name = lower(name) AND name <> upper(name) THEN {base.title_case('name')} ELSE name END) AS normalized_name,
              coalesce(arg_min(coalesce(regexp_extract(piece, '(?i)\\b[0-9]+(?:\\.[0-9]+)?\\s*{_units}(?:\\s*/\\s*[0-9]+(?:\\.[0-9]+)?\\s*{_units})?\\b'), ''), (ci, pi)), '') AS strength,
              upper(coalesce(regexp_extract(piece, '(?i)\\(UNII:\\s*([A-Z0-9]+)\\)', 1), '')) AS unii
            FROM cleaned WHERE name IS NOT NULL GROUP BY doc_id, name, upper(coalesce(regexp_extract(piece, '(?i)\\(UNII:\\s*([A-Z0-9]+)\\)', 1), ''))""",
    ),
)
def narrative_ingredients(spark, sf):
    """Every document read as an ingredient narrative, whole texts."""
    # the one shuffle, by document, comes before the costly rules: they are spread whatever the splits of the
    # scan, and a document's pieces are grouped where they are
    docs = derived.table(spark, sf, "documents").select("doc_id", "text").repartition("doc_id")
    rows = docs.select("doc_id", F.posexplode(ingredients.split_candidates(F.col("text"))).alias("pos", "piece"))
    entry = ingredients.build_entry(F.col("piece"), "narrative_text", "inactive")
    rows = rows.withColumn("e", entry).filter("e IS NOT NULL")
    # first piece per (document, name, unii): grouped where the document's pieces are, not an array scan per document
    first = F.min(F.struct("pos", "e.raw_name", "e.normalized_name", "e.strength")).alias("first")
    rows = rows.groupBy("doc_id", F.col("e.display_name").alias("display_name"), F.coalesce("e.unii", F.lit("")).alias("unii")).agg(first)
    return rows.select(
        "doc_id",
        "display_name",
        F.md5("first.raw_name").alias("raw_name"),
        F.col("first.normalized_name").alias("normalized_name"),
        F.coalesce("first.strength", F.lit("")).alias("strength"),
        "unii",
    )


@query(
    "named_entries",
    base.with_ctes(
        [_chunks, _cleaned],
        "SELECT doc_id, CAST(count(DISTINCT lower(name)) AS BIGINT) AS names, CAST(count(*) AS BIGINT) AS pieces FROM cleaned "
        "GROUP BY doc_id",
    ),
)
def named_entries(spark, sf):
    docs = derived.table(spark, sf, "documents").select("doc_id", "text").repartition("doc_id")
    rows = docs.select("doc_id", F.explode(ingredients.split_candidates(F.col("text"))).alias("piece"))
    rows = rows.withColumn("name", F.lower(ingredients.cleanup_name(F.col("piece"))))
    return rows.groupBy("doc_id").agg(
        F.count_distinct("name").alias("names"), F.count(F.lit(1)).alias("pieces")
    )


# --- display forms ------------------------------------------------------------------

_shown_sql = f"""
shown AS (
  SELECT p_partkey, upper(p_name) || ' ' || {base.pick(derived.FORMS, 'p_partkey')} || ' -' || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE ' [' || p_brand || ' LLC]' END AS title,
    p_name || ' of the ' || {base.pick('extended release|Tablets|SOLUTION|oral drops|xr|kit', 'p_partkey')} AS product,
    {base.pick('2024-0|2023-1|x', 'p_partkey')} || (p_partkey % 3) || '-17' AS day,
    p_size || {base.pick(' mg| mg/5 mL|/10 g||.5%', 'p_partkey')} AS strength,
    lower(p_name) || '; ' || p_brand AS actives FROM part
)"""


def _shown(spark, sf):
    p = F.col("p_partkey")
    part = derived.table(spark, sf, "part")
    label = F.when(p % 5 == 0, "").otherwise(F.concat(F.lit(" ["), F.col("p_brand"), F.lit(" LLC]")))
    return part.select(
        "p_partkey",
        F.concat(F.upper("p_name"), F.lit(" "), derived._pick(derived.FORMS, p), F.lit(" -"), label).alias("title"),
        F.concat(
            F.col("p_name"), F.lit(" of the "), derived._pick("extended release|Tablets|SOLUTION|oral drops|xr|kit", p)
        ).alias("product"),
        F.concat(derived._pick("2024-0|2023-1|x", p), (p % 3).cast("string"), F.lit("-17")).alias("day"),
        F.concat(F.col("p_size").cast("string"), derived._pick(" mg| mg/5 mL|/10 g||.5%", p)).alias("strength"),
        F.concat_ws("; ", F.lower("p_name"), "p_brand").alias("actives"),
    )


_suffix = vocab.TRAILING_FORMULATION_PATTERN.replace("(?i)", "")
_cut = f"trim(trim(trim(regexp_replace(product, '{_suffix}', '', 'i')), ',;-'))"
_head = (
    "array_to_string(list_transform(string_split({0}, ' '), lambda w, i: CASE WHEN i > 1 AND lower(w) IN ("
    + ", ".join(base.quote(w) for w in vocab.SMALL_WORDS)
    + ") THEN lower(w) ELSE upper(w[1]) || lower(w[2:]) END), ' ')"
)
_number = "regexp_replace(regexp_extract(strength, '([0-9]+(?:\\.[0-9]+)?(?:\\s*/\\s*[0-9]+(?:\\.[0-9]+)?)?)', 1), '\\s+', '', 'g')"


@query(
    "display_forms",
    base.with_ctes(
        [_shown_sql],
        f"""SELECT p_partkey, CASE WHEN contains(title, '[') THEN trim(split_part(title, '[', 1)) ELSE title END AS title_name,
              CASE WHEN contains(title, '[') THEN regexp_extract(title, '\\[(.+)\\]', 1) END AS title_labeler,
              {base.title_case("CASE WHEN contains(title, '[') THEN trim(split_part(title, '[', 1)) ELSE title END")} AS clean_title,
              {_head.format(f"CASE WHEN {_cut} <> '' THEN {_cut} ELSE product END")} AS display_name,
              CASE WHEN try_strptime(day, '%Y-%m-%d') IS NULL THEN day
                ELSE strftime(try_strptime(day, '%Y-%m-%d'), '%B ') || day(try_strptime(day, '%Y-%m-%d')) || strftime(try_strptime(day, '%Y-%m-%d'), ', %Y') END AS long_date,
              {base.title_case("split_part(actives, ';', 1)")} AS primary_active,
              round(CASE WHEN contains({_number}, '/') AND CAST(split_part({_number}, '/', 2) AS DOUBLE) <> 0
                THEN CAST(split_part({_number}, '/', 1) AS DOUBLE) / CAST(split_part({_number}, '/', 2) AS DOUBLE)
                ELSE CAST(split_part({_number}, '/', 1) AS DOUBLE) END, 6) AS strength_value
            FROM shown""",
    ),
)
def display_forms(spark, sf):
    name, labeler = text.split_title(F.col("title"))
    return _shown(spark, sf).select(
        "p_partkey",
        name.alias("title_name"),
        labeler.alias("title_labeler"),
        text.clean_title(F.col("title")).alias("clean_title"),
        text.display_name(F.col("product")).alias("display_name"),
        text.long_date(F.col("day")).alias("long_date"),
        text.primary_active(F.col("actives")).alias("primary_active"),
        F.round(text.strength_sort_value(F.col("strength")), 6).alias("strength_value"),
    )


@query(
    "strength_summaries",
    base.with_ctes(
        [base.LINES],
        """SELECT setid, string_agg(strength, ', ' ORDER BY p) AS strengths FROM (
             SELECT setid, strength, min(pos) AS p FROM ings WHERE strength IS NOT NULL GROUP BY setid, strength) s GROUP BY setid""",
    ),
)
def strength_summaries(spark, sf):
    rows = derived.label_records(spark, sf)
    return rows.select(
        "setid", text.strength_summary(F.transform("actives", lambda a: a["strength"])).alias("strengths")
    )
