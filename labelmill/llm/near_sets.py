"""Near-duplicate texts by their word shingles: Jaccard similarity of at least 0.8, verified on the sets.

A text is the set of its ``WORDS``-word shingles (a shorter one is a single
shingle).  Words are those of any script: white space and letter case are
Unicode's, and a character of a script that is written without spaces is a word.

Sets whose SimHashes differ in at most two bits are found by Golay keys
(``golay_simhash.links``).  At a similarity of 0.8 two SimHashes differ in about
ten bits, and Golay keys of so wide a radius select nothing, so what they miss
is found by bands: candidates also share a band of ``ROWS`` min-hashes, one of
``BANDS``.  A pair of similarity s has none in common with probability
(1 - s**6)**36, that is 1.8e-5 at 0.8 and less above.  A candidate of either
kind counts if 9 |A & B| >= 4 (|A| + |B|), which is Jaccard >= 4/5 in whole
numbers.  Groups are connected components.

Texts of a band are not paired with each other.  The text that meets most
others leads a band (in a group of copies that is their original), every other
text of the band is compared with its leader only, and what differs from the
leader is kept: D(X), the shingles of X that the leader L lacks and those of L
that X lacks.  Two texts A and B of a band can then be alike without a chain
over the leader only if one, say B, is not alike to L, that is
|D(B)| > (|B| + |L|) / 9.  As |D(A) ^ D(B)| = |A ^ B| <= (|A| + |B|) / 9, the
differences have s >= (|D(A)| + |D(B)| - (|A| + |B|) / 9) / 2 shingles in common,
and with |A| <= |L| + |D(A)| that is more than 4/9 of D(A).  So both have one of
them among their |D| - s + 1 rarest: each text is looked up by these, dealt out
by classes of the other's |D|, with the last word on s where the two meet.  Rare
differences are shared by few, so a large group costs some rows for each
difference instead of one for each pair, and no pair that shares a band is
lost.  Texts of a leader that has ``SMALL`` or fewer are paired.

Null and wordless texts form one group; rows without an id come last in their
group; of equal rows one stays.  Texts of any length are read whole.  Equal
sets are known by a 64-bit digest: of n texts about n**2 / 2**65 pairs would be
taken for equal that are not.  An empty table gives an empty table; columns of
the input keep their names, whatever they are.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelmill.llm import golay_simhash
from labelmill.llm.common import drop, free_prefix, keep, prepare, text_column, with_text_column
from labelmill.llm.components import components

WORDS = 5
BANDS = 36
ROWS = 6
#: Texts of a leader up to which they are paired with each other.
SMALL = 8
#: Least sizes of the classes of differences: each half as large again as the one before.
CLASSES = [1]
while CLASSES[-1] < 1 << 30:
    CLASSES.append(max(CLASSES[-1] + 1, CLASSES[-1] * 3 // 2))
#: Hashes multiplied at a time.
BLOCK = 512
#: Characters of scripts without spaces between words: Thai to Burmese, Khmer, Kana, Han.
_SPACELESS = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")
_FACTORS = np.random.default_rng(5).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def words_of(text: str) -> list[bytes]:
    """The words of a text in any script, without letter case."""
    if text.isascii():
        return golay_simhash.ascii_words(text)
    return [w.encode("utf-8") for w in _SPACELESS.sub(r" \1 ", text.casefold()).split()]


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct hashes of the shingles, ascending."""
    parts = list(golay_simhash.shingle_hashes(text, WORDS, words_of))
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, dtype=np.uint64)


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key for every band of min-hashes; none for an empty set."""
    if not len(hashes):
        return np.empty(0, dtype=np.int64)
    least = np.full(len(_FACTORS), ~np.uint64(0))
    for lo in range(0, len(hashes), BLOCK):
        least = np.minimum(least, (hashes[lo : lo + BLOCK, None] * _FACTORS).min(axis=0))
    digest = lambda i, row: int.from_bytes(hashlib.blake2b(row.tobytes() + bytes([i]), digest_size=8).digest(), "little", signed=True)
    return np.array([digest(i, row) for i, row in enumerate(least.reshape(BANDS, ROWS))], dtype=np.int64)


def _marked(texts: list[str | None]) -> dict[str, list]:
    sets = [shingle_set(t) for t in texts]
    digest = lambda s: int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)
    blocks = lambda s: (s[lo : lo + golay_simhash.COUNTED] for lo in range(0, len(s), golay_simhash.COUNTED))
    prints = [golay_simhash._signed(golay_simhash.simhash(blocks(s))) if len(s) else None for s in sets]
    return {"set_id": [digest(s) for s in sets], "bands": [bands(s) for s in sets], "print": prints}


def alike(both: Column, one: Column, other: Column) -> Column:
    """Whether sets of two sizes with so many shingles in common are alike by 4/5."""
    return 9 * both.cast("long") >= 4 * (one.cast("long") + other)


def could_be(one: Column, other: Column) -> Column:
    """Whether sets of two sizes can be alike by 4/5."""
    return 5 * F.least(one, other) >= 4 * F.greatest(one, other)


def _followers(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(led, set_id, size, is_near, more, less): each text of a shared band against the band's leader."""
    sizes = members.groupBy("key").agg(F.count("*").alias("n"))
    score = members.join(sizes, "key").groupBy("set_id").agg(F.sum("n").alias("score"))
    rank = F.struct("score", "set_id")
    led = members.join(score, "set_id").groupBy("key").agg(F.max(rank)["set_id"].alias("led"))
    met = members.join(led, "key").filter("led <> set_id").select("led", "set_id").distinct()
    own = sets.select("set_id", F.col("hashes").alias("x"))
    leaders = sets.select(F.col("set_id").alias("led"), F.col("hashes").alias("y"))
    compared = met.join(own, "set_id").join(leaders, "led")
    more, less = F.array_except("x", "y"), F.array_except("y", "x")
    found = compared.select("led", "set_id", F.size("x").alias("size"), F.size("y").alias("led_size"), more.alias("more"), less.alias("less"))
    near = alike(F.col("size") - F.size("more"), F.col("size"), F.col("led_size"))
    return found.select("led", "set_id", F.col("size").cast("long").alias("size"), near.alias("is_near"), "more", "less")


def _apart(followers: DataFrame, placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Followers with their component, of leaders that have others and leave some apart: of few texts, of many."""
    own = placed.select(F.col("node").alias("set_id"), F.col("component").alias("own"))
    its = placed.select(F.col("node").alias("led"), F.col("component").alias("its"))
    known = followers.join(own, "set_id", "left").join(its, "led", "left")
    known = known.withColumn("own", F.coalesce("own", "set_id")).withColumn("its", F.coalesce("its", "led"))
    known = keep(known.withColumn("is_open", F.col("own") != F.col("its")).drop("its"), "near-open")
    crowd = known.groupBy("led").agg(F.count("*").alias("n"), F.max("is_open").alias("some")).filter("n > 1 AND some").select("led", "n")
    crowds = keep(known.join(crowd, "led"), "near-crowds")
    drop(known)
    return crowds.filter(F.col("n") <= SMALL), crowds.filter(F.col("n") > SMALL)


def _class(n: Column) -> Column:
    return F.size(F.filter(F.array(*[F.lit(c) for c in CLASSES]), lambda low: low <= n))


def _by_class(ranked: DataFrame, common) -> DataFrame:
    """Differences under each class of others that may be alike, as far as they are among the rarest for it.

    ``common`` gives the least number of common differences with others of the
    class that begins at a size; sizes differ by a quarter, differences by a
    quarter of the size at most.
    """
    n, size, nth = F.col("n"), F.col("size"), F.col("nth")
    long = lambda x: F.lit(x).cast("long")
    bounds = zip(CLASSES, [*CLASSES[1:], 1 << 31])
    classes = F.array(*[F.struct(F.lit(i + 1).alias("other"), long(lo).alias("low"), long(hi).alias("high")) for i, (lo, hi) in enumerate(bounds)])
    within = lambda c: (4 * c["low"] <= 4 * n + size) & (4 * c["high"] > 4 * n - size)
    near = F.filter(classes, lambda c: within(c) & (nth <= n - F.greatest(common(c["low"]), F.lit(1)) + 1))
    return ranked.withColumn("other", F.explode(F.transform(near, lambda c: c["other"])))


def _candidates(followers: DataFrame, placed: DataFrame) -> DataFrame:
    """(a, b) of texts that their leader does not connect and that may be alike."""
    few, many = _apart(followers, placed)
    one = lambda df, *more: df.select("led", F.col("set_id").alias("a"), F.col("size").alias("a_size"), F.col("own").alias("a_own"), *more)
    other = lambda df, *more: df.select("led", F.col("set_id").alias("b"), F.col("size").alias("b_size"), F.col("own").alias("b_own"), *more)
    wanted = (F.col("a_own") != F.col("b_own")) & could_be(F.col("a_size"), F.col("b_size"))
    paired = one(few).join(other(few.filter("is_open")), "led").filter(wanted)
    rows = many.withColumn("differences", F.concat("more", "less"))
    rows = rows.select("led", "set_id", "size", "own", "is_open", F.size("differences").cast("long").alias("n"), F.explode("differences").alias("shingle"))
    rows = keep(rows, "near-differences")
    held = rows.groupBy("led", "shingle").agg(F.count("*").alias("held"))
    rarest = Window.partitionBy("led", "set_id").orderBy("held", "shingle")
    ranked = rows.join(held, ["led", "shingle"]).withColumn("nth", F.row_number().over(rarest)).filter("held > 1")
    ranked = keep(ranked.withColumn("class", _class(F.col("n"))), "near-differences-ranked")
    drop(rows)
    shared = lambda low: F.ceil((4 * F.col("n") + 4 * low - F.col("size")) / 8)
    first = _by_class(ranked, lambda low: F.greatest(shared(low), F.floor(4 * F.col("n") / 9) + 1))
    last = _by_class(ranked.filter("is_open"), lambda low: F.greatest(shared(low), F.floor(4 * low / 9) + 1))
    first = one(first, "shingle", F.col("class").alias("a_class"), F.col("other").alias("b_class"), F.col("n").alias("a_n"), F.col("nth").alias("a_nth"))
    last = other(last, "shingle", F.col("other").alias("a_class"), F.col("class").alias("b_class"), F.col("n").alias("b_n"), F.col("nth").alias("b_nth"))
    common = F.ceil((9 * (F.col("a_n") + F.col("b_n")) - F.col("a_size") - F.col("b_size")) / 18)
    early = (F.col("a_nth") <= F.col("a_n") - common + 1) & (F.col("b_nth") <= F.col("b_n") - common + 1)
    looked_up = first.join(last, ["led", "shingle", "a_class", "b_class"]).filter(wanted & early)
    found = paired.select("a", "b").union(looked_up.select("a", "b"))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _by_prints(prints: DataFrame) -> DataFrame:
    """(a, b) of sets (``set_id``, ``print``) whose SimHashes are linked; those of one SimHash meet in its smallest set."""
    first = keep(prints.filter("print IS NOT NULL").groupBy(F.col("print").alias("fp")).agg(F.min("set_id").alias("least")), "near-prints")
    same = prints.join(first, F.col("print") == F.col("fp")).select(F.col("least").alias("a"), F.col("set_id").alias("b"))
    own = lambda side: first.select(F.col("fp").alias(side), F.col("least").alias(f"of_{side}"))
    linked = golay_simhash.links(first).join(own("a"), "a").join(own("b"), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    return same.filter("a <> b").union(linked)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose sets are alike."""
    one = sets.select(F.col("set_id").alias("a"), F.col("hashes").alias("x"))
    other = sets.select(F.col("set_id").alias("b"), F.col("hashes").alias("y"))
    near = alike(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"))
    return pairs.join(other, "b").join(one, "a").filter(near).select("a", "b")


def _groups(members: DataFrame, linked: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, component) of the sets that are near another one; ``linked`` are candidate pairs by their SimHashes."""
    followers = keep(_followers(members, sets), "near-followers")
    links = followers.filter("is_near").select(F.col("led").alias("a"), F.col("set_id").alias("b"))
    placed = keep(components(links, "a", "b"), "near-components")
    # verified with the others, so that the sets are shuffled once for all
    pairs = keep(_candidates(followers, placed).union(linked), "near-candidates")
    drop(followers, linked)
    late = _verified(pairs, sets)
    known = placed.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    return components(known.union(late), "a", "b")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The row with the smallest id of every near-duplicate group, with the columns of ``docs``."""
    prepare(docs.sparkSession)
    free = free_prefix(docs)
    set_id, keys, print_, group, first, nth = (free + c for c in ("set_id", "bands", "print", "group", "first", "nth"))
    column = text_column("set_id long, bands array<long>, print long", _marked)
    marked = keep(with_text_column(docs, column, text, ["set_id", "bands", "print"], free), "shingle-sets")
    found = marked.select(F.col(set_id).alias("set_id"), F.col(keys).alias("bands"), F.col(print_).alias("print"))
    linked = keep(_by_prints(found.select("set_id", "print").distinct()), "near-linked")
    distinct = found.groupBy("set_id").agg(F.first("bands").alias("bands"))
    members = distinct.select(F.explode("bands").alias("key"), "set_id")
    met = members.groupBy("key").agg(F.min("set_id").alias("lo"), F.max("set_id").alias("hi")).filter("lo < hi").select("key")
    members = keep(members.join(met, "key"), "shared-bands")
    whole = text_column("hashes array<long>", lambda texts: {"hashes": [shingle_set(t).view(np.int64) for t in texts]})
    wanted = members.select("set_id").union(linked.select("a")).union(linked.select("b")).distinct()
    texts = marked.select(F.col(set_id).alias("set_id"), F.col(text).alias("text")).join(wanted, "set_id", "left_semi").dropDuplicates(["set_id"])
    sets = keep(with_text_column(texts, whole, "text", ["hashes"]).select("set_id", "hashes"), "candidate-sets")
    groups = _groups(members, linked, sets).select(F.col("node").alias(set_id), F.col("component").alias(group))
    grouped = marked.drop(keys, print_).join(groups, set_id, "left").withColumn(group, F.coalesce(group, set_id))
    place = F.struct(F.col(doc_id).isNull().alias("blank"), F.col(doc_id).alias("id"), F.col(set_id).alias("set_id"), F.xxhash64(text).alias("tie"))
    chosen = grouped.groupBy(group).agg(F.min(place).alias(first))
    kept = grouped.join(chosen, group).filter(place.eqNullSafe(F.col(first)))
    same = Window.partitionBy(group).orderBy(F.col(first)["tie"])  # equal rows only
    return kept.withColumn(nth, F.row_number().over(same)).filter(F.col(nth) == 1).select(docs.columns)
