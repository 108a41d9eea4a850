"""Secrets in texts, told apart by who owns them across the corpus; DataFrame functions only.

Three patterns give the base spans: ``assign`` (a name such as password or
token, then a value of 6 characters or more), ``access`` (AKIA and capitals or
digits, 20 characters or more) and ``hex`` (24 lower-case hex digits or more),
each leftmost and without overlaps.  Bare tokens of 20 characters or more that
look like keys are candidates beside them.

Ownership.  The SHA-256 of every candidate's value is counted over the corpus:
distinct repositories and, through them, distinct owners.  A value that
``wide`` owners or more hold is a copied example; one of fewer owners that
looks live (long, digits and letters, many different characters, no word such
as *example*) is live; the rest is weak.  Base spans stay whatever they are; a
bare token that is live and touches no base span is added as ``owned``.

Counts are made in three aggregations (value, owner and repository; value and
owner; value), each combined before its shuffle, so a value that a third of
all rows hold is a few rows by then.  It meets its occurrences again by a
broadcast of the values with more than ``HOT`` repositories, of which there are
at most candidates / HOT; the others are joined by value, with at most HOT
repositories to a key.

Null texts are empty and have no spans; a null owner counts as the owner '',
a null id as a repository of its own.  A text of any length is read whole; its
spans are rows, not one array, until they are put together for its own row.
Repeated rows are one repository (equal ids) and give a row each.  Ties in
start are ordered as the kinds are listed.  An empty table gives an empty
table.  Only the id, text and owner columns are read, so others cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelmill.llm.common import keep, prepare

# fixed values: the patterns, the least number of characters and the order of the kinds
_NAMES = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = f"({_NAMES})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
TOKEN = "[A-Za-z0-9+/_=-]+"
#: kind: pattern, group of the value, least characters of the value, a pattern that every match of that length contains
KINDS = {
    "assign": (ASSIGN, 2, 6, ASSIGN),
    "access": (ACCESS, 0, 20, "AKIA[A-Z0-9]{16}"),
    "hex": (HEX, 0, 24, "[0-9a-f]{24}"),
    "owned": (TOKEN, 0, 20, "[A-Za-z0-9+/_=-]{20}"),
}
BASE = ("assign", "access", "hex")
PLACEHOLDER = "example|sample|dummy|placeholder|changeme|xxxx"

#: Owners from which on a value counts as widely copied.
WIDE = 3
LIVE_LENGTH = 20
LIVE_CHARACTERS = 10
#: Repositories from which on a value is broadcast.
HOT = 10_000

_SPAN = "array<struct<kind:int,start:long,end:long,sha:string,looks_live:boolean>>"


def _running(sizes: Column) -> Column:
    """Running sums of an array of longs, by shifts of 1, 2, 4, ...: n log n for n entries."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(sizes) + F.lit(1))).cast("int"))

    def add(sums: Column, k: Column) -> Column:
        shifted = F.concat(F.array_repeat(F.lit(0).cast("long"), F.pow(F.lit(2), k).cast("int")), sums)
        return F.zip_with(sums, F.slice(shifted, F.lit(1), F.size(sums)), lambda x, y: x + y)

    return F.aggregate(rounds, sizes, add)


def looks_live(value: Column) -> Column:
    """Long enough, with digits and letters, many different characters and no word of a placeholder."""
    characters = F.size(F.array_distinct(F.split(value, "")))
    return (
        (F.char_length(value) >= LIVE_LENGTH) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")
        & (characters >= LIVE_CHARACTERS) & ~F.lower(value).rlike(PLACEHOLDER)
    )


def _wanted(kind: int, least: int):
    """Whether a match counts: base ones by their length, bare tokens if they look live.

    A bare token with an access key or hex digits in it is found by those kinds.
    """
    others = "|".join(KINDS[k][3] for k in ("access", "hex"))
    if kind < len(BASE):
        return lambda x: F.char_length(x["v"]) >= least
    return lambda x: looks_live(x["v"]) & ~x["v"].rlike(others)


def _span(kind: int):
    start = lambda x: x["e"] - F.char_length(x["w"])
    return lambda x: F.struct(
        F.lit(kind).alias("kind"), start(x).alias("start"), x["e"].alias("end"), F.sha2(x["v"], 256).alias("sha"), looks_live(x["v"]).alias("looks_live")
    )


def _candidates(docs: DataFrame, doc_id: str, text: str, owner: str) -> DataFrame:
    """(row, doc_id, owner, spans) of every row: one reading of the texts."""
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<string>")
    when = lambda has, made: F.when(t.rlike(has), made).otherwise(none)
    matches, spans = [], []
    for i, (pattern, group, least, has) in enumerate(KINDS.values()):
        # runs of characters below the least length match as well: they cannot be skipped, as gaps are counted
        shown = pattern if group else pattern[:-1] + f"{{{least - (4 if pattern == ACCESS else 0)},}}"
        matches.append(when(has, F.regexp_extract_all(t, F.lit(shown), F.lit(0))).alias(f"whole{i}"))
        matches.append(when(has, F.split(t, shown, -1)).alias(f"gaps{i}"))
        if group:
            matches.append(when(has, F.regexp_extract_all(t, F.lit(shown), F.lit(group))).alias(f"values{i}"))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(owner), F.lit("")).alias("owner"), *matches
    )
    sums = []
    for i in range(len(KINDS)):
        whole = F.col(f"whole{i}")
        sizes = F.zip_with(F.slice(f"gaps{i}", F.lit(1), F.size(whole)), whole, lambda g, w: (F.char_length(g) + F.char_length(w)).cast("long"))
        sums.append(_running(sizes).alias(f"ends{i}"))
    rows = rows.select("*", *sums)
    for i, (_, group, least, _) in enumerate(KINDS.values()):
        value = f"values{i}" if group else f"whole{i}"
        zipped = F.arrays_zip(F.col(f"ends{i}").alias("e"), F.col(f"whole{i}").alias("w"), F.col(value).alias("v"))
        spans.append(F.transform(F.filter(zipped, _wanted(i, least)), _span(i)).cast(_SPAN))
    return rows.select("row", "doc_id", "owner", F.concat(*spans).alias("spans"))


def ownership(spans: DataFrame) -> DataFrame:
    """(sha, owners, repositories) of every value of (sha, owner, repository, ...)."""
    held = spans.select("sha", "owner", "repository").distinct()
    by_owner = held.groupBy("sha", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("sha").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))


def _with_ownership(spans: DataFrame) -> DataFrame:
    """``spans`` with the owners and repositories of their values."""
    counted = keep(ownership(spans), "secret-owners")
    hot = F.broadcast(counted.filter(F.col("repositories") > HOT))
    often = spans.join(hot, "sha")
    seldom = spans.join(hot, "sha", "left_anti").join(counted.filter(F.col("repositories") <= HOT), "sha")
    return often.unionByName(seldom)


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", wide: int = WIDE) -> DataFrame:
    """(doc_id, secrets) of every row of ``docs``.

    ``secrets`` lists struct(start, kind_no, kind, end, sha, owners,
    repositories, verdict) by start, then kind; places are code points, the
    end is exclusive; verdict is copied, live or weak.  ``doc_id`` names the
    column of the repository.
    """
    prepare(docs.sparkSession)
    rows = keep(_candidates(docs, doc_id, text, owner), "secret-candidates")
    spans = rows.filter(F.size("spans") > 0).select("row", "doc_id", "owner", F.explode("spans").alias("s")).select("row", "doc_id", "owner", "s.*")
    repository = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.col("row").cast("string")))
    spans = spans.select("row", "owner", repository.alias("repository"), "kind", "start", "end", "sha", "looks_live")
    base = F.col("kind") < len(BASE)
    in_row = Window.partitionBy("row").rowsBetween(Window.unboundedPreceding, -1)
    before = F.max(F.when(base, F.col("end"))).over(in_row.orderBy("start", "kind"))
    after = F.min(F.when(base, F.col("start"))).over(in_row.orderBy(F.desc("start"), F.desc("kind")))
    apart = spans.withColumn("before", before).withColumn("after", after)
    clear = (F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.col("after").isNull() | (F.col("after") >= F.col("end")))
    spans = keep(apart.filter(base | clear).drop("before", "after"), "secret-spans")
    live = F.col("looks_live") & (F.col("owners") < wide)
    verdict = F.when(F.col("owners") >= wide, "copied").when(live, "live").otherwise("weak")
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    judged = _with_ownership(spans).filter(base | live)
    secret = F.struct("start", F.col("kind").alias("kind_no"), kind.alias("kind"), "end", "sha", "owners", "repositories", verdict.alias("verdict"))
    found = judged.groupBy("row").agg(F.sort_array(F.collect_list(secret)).alias("secrets"))
    some = rows.filter(F.size("spans") > 0).select("row", "doc_id").join(found, "row", "left")
    secrets = F.coalesce("secrets", F.array().cast(found.schema["secrets"].dataType)).alias("secrets")
    rest = rows.filter(F.size("spans") == 0).select("doc_id", F.lit(None).cast(found.schema["secrets"].dataType).alias("secrets"))
    return some.select("doc_id", "secrets").unionByName(rest).select("doc_id", secrets)


def listed(secrets: Column) -> Column:
    """Secrets as kind:start:end, joined by commas."""
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def only(secrets: Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(secrets, lambda s: s["kind"].isin(*kinds))


def judged(secrets: Column, verdict: str) -> Column:
    """The number of secrets with a verdict."""
    return F.size(F.filter(secrets, lambda s: s["verdict"] == verdict)).cast("long")
