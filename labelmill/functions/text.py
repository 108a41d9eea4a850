"""String expressions: normalisation, casing, splitting, display forms.

All functions take and return Columns and stay inside the JVM.  ``[\\p{L}\\p{N}_]``
is written out where a Unicode word character is meant, because Java's ``\\w``
is ASCII only; ``(?U)`` switches ``\\b`` and ``\\s`` to Unicode rules.  Lower-casing
is used where full case folding would differ only for letters such as sharp s.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelmill import vocab


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it any number of times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def strip(c: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squash(c: Column) -> Column:
    """Collapse white space runs to one blank and trim."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip_chars(c: Column, chars: str) -> Column:
    """Remove the given characters from both ends."""
    return F.btrim(c, F.lit(chars))


def normalize_text(c: Column) -> Column:
    """Lower case, punctuation other than hyphens to blanks, runs collapsed."""
    c = F.lower(c)
    # one cheap look spares texts that are normal already the three replacements
    odd = F.rlike(c, F.lit(r"[^a-z0-9_ -]|--|  |^ | \z"))
    blanked = F.regexp_replace(c, r"(?U)[^\p{L}\p{N}_\s-]", " ")
    return F.when(~odd, c).otherwise(squash(F.regexp_replace(blanked, "-+", "-")))


def normalize_simple(c: Column) -> Column:
    return squash(F.lower(c))


def normalize_excipient(c: Column) -> Column:
    """Canonical low-noise form of an excipient name ('' for NULL)."""
    c = F.lower(F.coalesce(c, F.lit("")))
    c = F.replace(F.replace(c, F.lit("&"), F.lit(" and ")), F.lit("#"), F.lit(" no "))
    c = F.translate(c, "_-", "  ")
    c = F.regexp_replace(c, r"(?U)\b(?:number|no)\.?\b", " no ")
    c = squash(F.regexp_replace(c, r"(?U)[^\p{L}\p{N}\s]", " "))
    for pattern, replacement in vocab.CANONICAL_REWRITES:
        c = F.regexp_replace(c, "(?U)" + pattern, replacement)
    return squash(c)


def capitalize(word: Column) -> Column:
    """First character in title form (sharp s gives Ss), the rest lower."""
    first = F.upper(F.substring(word, 1, 1))
    return F.concat(
        F.substring(first, 1, 1),
        F.lower(first.substr(F.lit(2), F.length(first))),
        F.lower(word.substr(F.lit(2), F.length(word))),
    )


def title_case(c: Column) -> Column:
    """First letter of every run of letters upper, the others lower."""
    runs = F.regexp_extract_all(c, F.lit(r"(?s)(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, capitalize), "")


def is_lower_case(c: Column) -> Column:
    """True when there are letters and none of them is upper case."""
    return (c == F.lower(c)) & (c != F.upper(c))


def literal_array(values: Sequence[str]) -> Column:
    """A constant array of strings (one parsed expression, folded by the optimizer)."""
    quoted = ", ".join("r'" + v + "'" if "'" not in v else '"' + v + '"' for v in values)
    return F.expr(f"array({quoted})")


def first_keyword(lowered: Column, keywords: Sequence[str] | Column) -> Column:
    """First keyword, in list order, contained in the text; NULL if none."""
    words = keywords if isinstance(keywords, Column) else literal_array(keywords)
    return F.get(F.filter(words, lambda k: F.contains(lowered, k)), F.lit(0))


def contains_any(text: Column, keywords: Sequence[str]) -> Column:
    return F.exists(literal_array(keywords), lambda k: F.contains(text, k))


def split_list(c: Column) -> Column:
    """Split a ``; `` list on semicolons, trimmed, blanks dropped."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ";"), strip)
    return F.filter(parts, lambda p: p != "")


def primary_active(c: Column) -> Column:
    """Display form of the first entry of a ``; `` list."""
    first = strip(F.get(F.split(c, ";"), F.lit(0)))
    return F.coalesce(title_case(blank_to_null(first)), F.lit("Unknown"))


def keep_first_by(items: Column, key: Callable[[Column], Column], empty: Column) -> Column:
    """Distinct array elements by key, first one wins, order kept.

    ``empty`` is an empty array of the element type, the result for NULL.
    """
    # position of the first element with the same key: the items and their keys are built once
    keyed = bind(
        items,
        lambda every: bind(
            F.transform(every, lambda item: F.coalesce(key(item), F.lit(""))),
            lambda keys: F.filter(every, lambda item, i: F.array_position(keys, F.get(keys, i)) == i + 1),
        ),
    )
    return F.coalesce(keyed, empty)


def strength_summary(strengths: Column) -> Column:
    """Distinct strengths, ignoring case, in order, joined by ', '."""
    cleaned = F.filter(F.transform(strengths, lambda s: squash(F.coalesce(s, F.lit("")))), lambda s: s != "")
    kept = keep_first_by(cleaned, F.lower, F.array().cast("array<string>"))
    return blank_to_null(F.array_join(kept, ", "))


def strength_sort_value(c: Column) -> Column:
    """First number, or ratio of two numbers, in the text; infinity if none."""
    found = F.regexp_replace(
        F.regexp_extract(c, r"(\d+(?:\.\d+)?(?:\s*/\s*\d+(?:\.\d+)?)?)", 1), r"\s+", ""
    )
    numbers = F.transform(F.split(found, "/"), lambda n: n.try_cast("double"))

    def value(n: Column) -> Column:
        left, right = F.get(n, F.lit(0)), F.get(n, F.lit(1))
        return F.coalesce(F.when(right != 0, left / right), left, F.lit(float("inf")))

    return bind(numbers, value)


def split_title(c: Column) -> tuple[Column, Column]:
    """``NAME [LABELER]`` to (name, labeler); labeler NULL when absent."""
    pattern = r"(?U)^(.+?)\s*\[(.+)\]\s*$"
    matches = F.rlike(c, F.lit(pattern))
    name = F.when(matches, strip(F.regexp_extract(c, pattern, 1))).otherwise(c)
    labeler = F.when(matches, strip(F.regexp_extract(c, pattern, 2)))
    return name, labeler


def clean_title(c: Column) -> Column:
    """Text before the last '[', title-cased."""
    before = F.regexp_extract(c, r"(?s)^(.*)\[", 1)
    return title_case(F.when(F.contains(c, F.lit("[")), strip(before)).otherwise(c))


def _headline(c: Column) -> Column:
    words = F.filter(F.split(squash(c), " "), lambda w: w != "")

    def shape(word: Column, i: Column) -> Column:
        small = F.lower(word).isin(vocab.SMALL_WORDS) & (i > 0)
        return F.when(small, F.lower(word)).otherwise(capitalize(word))

    return F.array_join(F.transform(words, shape), " ")


def display_name(c: Column) -> Column:
    """Product name without one trailing formulation word, in headline case."""
    c = F.coalesce(c, F.lit(""))
    cut = F.regexp_replace(c, "(?U)" + vocab.TRAILING_FORMULATION_PATTERN, "")
    cut = strip(strip_chars(strip(cut), ",;-"))
    return F.when(cut != "", _headline(cut)).otherwise(_headline(c))


def long_date(c: Column) -> Column:
    """``YYYY-MM-DD`` to ``Month d, yyyy``; anything else unchanged."""
    parsed = F.try_to_date(F.when(F.rlike(c, F.lit(r"^\d{4}-\d{1,2}-\d{1,2}$")), c), "yyyy-M-d")
    return F.coalesce(F.date_format(parsed, "MMMM d, yyyy"), c)


def numeric_aware(c: Column) -> Column:
    """Case-insensitive sort key in which digit runs compare as numbers."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(?s)(\d+|\D+)"), F.lit(1))

    def pad(run: Column) -> Column:
        digits = F.regexp_replace(run, "^0+(?=.)", "")
        width = F.lpad(F.length(digits).cast("string"), 6, "0")
        return F.when(F.rlike(run, F.lit("^[0-9]")), F.concat(width, digits)).otherwise(run)

    return F.array_join(F.transform(runs, pad), "")
