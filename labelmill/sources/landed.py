"""Landed JSON: product candidates, listings, terminology payloads.

The files are what a fetcher left in a folder; payload frames hold one JSON
text per row in ``payload``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill import vocab
from labelmill.functions import text
from labelmill.operators.ordered import first_per_key

CANDIDATE = (
    "rxcui string, setid string, ndc string, product_name string, labeler string, dosage_form string, route string, source string"
)


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Product candidate index: a JSON array of objects; unreadable input gives no rows."""
    rows = spark.read.schema(CANDIDATE).json(path, multiLine=True)
    names = rows.columns
    cleaned = rows.select(*[text.blank_to_null(text.strip(F.col(n))).alias(n) for n in names])
    # an unreadable file comes back as a row of NULLs
    return cleaned.filter(F.coalesce(*names).isNotNull())


def _items(payload: Column, path: str, schema: str) -> Column:
    """Array at a JSON path that may hold one object instead of a list."""
    found = F.get_json_object(payload, path)
    one = F.startswith(F.ltrim(found), F.lit("{"))
    return F.from_json(F.when(one, F.concat(F.lit("["), found, F.lit("]"))).otherwise(found), f"array<{schema}>")


def _clean(c: Column) -> Column:
    return text.blank_to_null(text.strip(c))


def listing_results(payloads: DataFrame, default_rxcui: Column | None = None) -> DataFrame:
    """Search results of listing payloads: title split into name and labeler."""
    items = _items(F.col("payload"), "$.data", "struct<title:string,setid:string,rxcui:string>")
    keep = [c for c in payloads.columns if c != "payload"]
    rows = payloads.select(*keep, F.posexplode(items).alias("seq", "i"))
    title = text.strip(F.coalesce("i.title", F.lit("")))
    name, labeler = text.split_title(title)
    rxcui = _clean(F.col("i.rxcui"))
    if default_rxcui is not None:
        rxcui = F.coalesce(rxcui, text.blank_to_null(default_rxcui))
    return rows.select(
        *keep,
        "seq",
        F.coalesce(text.blank_to_null(name), F.lit("Unknown product")).alias("product_name"),
        _clean(F.col("i.setid")).alias("setid"),
        labeler.alias("labeler"),
        rxcui.alias("rxcui"),
    )


_CONCEPT = "struct<rxcui:string,name:string,tty:string>"


def _groups(payloads: DataFrame, path: str) -> DataFrame:
    groups = _items(F.col("payload"), path, "struct<tty:string,conceptProperties:string>")
    keep = [c for c in payloads.columns if c != "payload"]
    rows = payloads.select(*keep, F.posexplode(groups).alias("group_seq", "g"))
    concepts = _items(F.col("g.conceptProperties"), "$", _CONCEPT)
    rows = rows.select(*keep, "group_seq", F.col("g.tty").alias("group_tty"), F.posexplode(concepts).alias("item_seq", "c"))
    return rows.select(
        *keep,
        F.array("group_seq", "item_seq").alias("seq"),  # compared part by part
        _clean(F.col("c.rxcui")).alias("rxcui"),
        _clean(F.col("c.name")).alias("name"),
        F.coalesce(_clean(F.col("c.tty")), _clean(F.col("group_tty"))).alias("tty"),
    )


def drug_concepts(payloads: DataFrame) -> DataFrame:
    """Concepts of drug payloads, score 5; incomplete ones are dropped."""
    rows = _groups(payloads, "$.drugGroup.conceptGroup").dropna(subset=["rxcui", "name", "tty"])
    return rows.withColumn("score", F.lit(5.0))


def related_concepts(payloads: DataFrame, keys: list[str]) -> DataFrame:
    """Ingredient concepts of related payloads: first per concept and key, score 0."""
    rows = _groups(payloads, "$.relatedGroup.conceptGroup").dropna(subset=["rxcui", "name"])
    rows = rows.withColumns({"tty": F.lit("IN"), "score": F.lit(0.0)})
    return first_per_key(rows, [*keys, "rxcui"], [F.col("seq")])


def approximate_concepts(payloads: DataFrame, properties: DataFrame, keys: list[str]) -> DataFrame:
    """Approximate-match payloads enriched with concept properties (rxcui, name, tty).

    Without properties the candidate's own name stays and the type is missing;
    rows without name or type are dropped.
    """
    items = _items(
        F.col("payload"), "$.approximateGroup.candidate", "struct<rxcui:string,name:string,score:string>"
    )
    keep = [c for c in payloads.columns if c != "payload"]
    rows = payloads.select(*keep, F.posexplode(items).alias("item_seq", "i"))
    rows = rows.select(
        *keep,
        F.array("item_seq").alias("seq"),
        _clean(F.col("i.rxcui")).alias("rxcui"),
        _clean(F.col("i.name")).alias("_own_name"),
        F.coalesce(F.col("i.score").try_cast("double"), F.lit(0.0)).alias("score"),
    )
    rows = first_per_key(rows.filter("rxcui IS NOT NULL"), [*keys, "rxcui"], [F.col("seq")])
    known = properties.select("rxcui", F.col("name").alias("_name"), F.col("tty").alias("_tty"))
    rows = rows.join(known, "rxcui", "left").select(
        *keep,
        "seq",
        "rxcui",
        F.coalesce(_clean(F.col("_name")), F.col("_own_name")).alias("name"),
        _clean(F.col("_tty")).alias("tty"),
        "score",
    )
    return rows.dropna(subset=["name", "tty"])


def all_candidates(exact: DataFrame, drugs: DataFrame, approximate: DataFrame) -> DataFrame:
    """Union of the three lookups in merge order; ``seq`` keeps it."""
    parts = []
    for i, (source, frame) in enumerate((("exact", exact), ("drugs", drugs), ("approximate", approximate))):
        order = F.concat(F.array(F.lit(i)), F.col("seq")).alias("seq")
        columns = [c for c in frame.columns if c != "seq"]
        parts.append(frame.select(*columns, order, F.lit(source).alias("source")))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p, allowMissingColumns=True)
    return union.filter(F.col("tty").isin(vocab.USEFUL_TTYS))
