"""Vectors of text, query and ingredient expressions."""

import itertools

import pytest
from pyspark.sql import functions as F

from labelmill.functions import ingredients, queries, text
from labelmill.operators import match
from labelmill.plans import concepts


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


def normalized(spark, raw):
    return queries.normalize_queries(spark.createDataFrame([(raw,)], "raw_text string")).first()


def test_query_trims_and_keeps_raw_text(spark):
    q = normalized(spark, "  metformin   oral   tablet  ")
    assert (q.raw_text, q.normalized_text) == ("  metformin   oral   tablet  ", "metformin oral tablet")
    assert (q.requested_route, q.requested_dose_form) == ("ORAL", "TABLET")


def test_query_ndc_and_strength(spark):
    q = normalized(spark, "0002-8215-01 amoxicillin 500 mg capsule")
    assert (q.ndc, q.requested_strength, q.requested_dose_form) == ("0002-8215-01", "500 mg", "CAPSULE")


def test_query_punctuation_and_units(spark):
    q = normalized(spark, " amoxicillin, 400mg / 5ml suspension!!! ")
    assert q.normalized_text == "amoxicillin 400 mg/5 mL suspension"
    assert (q.requested_strength, q.requested_dose_form) == ("400 mg/5 mL", "SUSPENSION")
    assert normalized(spark, "a_b 5UG - x-1 2-3 70%").normalized_text == "a b 5 mcg x 1 2-3 70%"


def test_query_key_is_stable(spark):
    assert normalized(spark, "Metformin tablet").query_key == normalized(spark, "metformin   tablet").query_key


def test_base_drug_name(spark):
    assert one(spark, queries.base_drug_name(F.lit("metformin Oral tablet"))) == "metformin"
    assert one(spark, queries.base_drug_name(F.lit("oral tablet"))) == "oral tablet"


def test_tokens_and_variants(spark):
    assert one(spark, queries.meaningful_tokens(F.lit("Red oral 5 mg red Widget"))) == ["red", "widget"]
    assert one(spark, queries.expand_abbreviations(F.lit("Acet oral susp"))) == "acet oral suspension"
    assert one(spark, queries.query_variants(F.lit("acet oral suspension"))) == ["acet oral suspension", "acet"]


def test_filter_terms(spark):
    assert one(spark, ingredients.filter_terms(F.lit("red dye, lactose; red dye"))) == ["red dye", "lactose"]
    spelled = "FD&C Red #40; fd and c red no 40; Red Dye"
    assert one(spark, ingredients.filter_terms(F.lit(spelled))) == ["FD&C Red #40", "Red Dye"]
    assert one(spark, ingredients.filter_terms(F.lit(None).cast("string"))) == []


def test_excipient_names(spark):
    assert one(spark, text.normalize_excipient(F.lit("FD&C Red #40"))) == "fdc red no 40"
    assert one(spark, text.normalize_excipient(F.lit("D&C Red No. 33"))) == "dc red no 33"


@pytest.mark.parametrize(
    ("term", "name", "unii", "expected"),
    [
        ("red dye", "FD&C Red No. 40", "WZB9127XOA", True),
        ("fd&c red #40", "FD&C Red No. 40", "WZB9127XOA", True),
        ("WZB9127XOA", "FD&C Red No. 40", "WZB9127XOA", True),
        ("glycerol", "glycerin", None, True),
        ("peg", "polyethylene glycol 400", None, True),
        ("polyethylene glycol", "polyethylene glycol 400", None, True),
        ("lactitol", "lactitol monohydrate", None, True),
        ("peg 3350", "polyethylene glycol 400", None, False),
    ],
)
def test_term_matches(spark, term, name, unii, expected):
    n, u = F.lit(name), F.lit(unii).cast("string")
    keys = ingredients.ingredient_keys(n, n, text.title_case(n), u)
    assert (one(spark, match.term_hits(F.array(F.lit(term)), keys)) == [term]) is expected


def test_strengths(spark):
    values = F.array(*[F.lit(v) for v in ("5 mg", "500  mg", "5 MG", "")])
    assert one(spark, text.strength_summary(values)) == "5 mg, 500 mg"
    assert one(spark, text.strength_sort_value(F.lit("100 mg/5 mL"))) == 100.0
    assert one(spark, text.strength_sort_value(F.lit("1 / 4"))) == 0.25
    assert one(spark, text.strength_sort_value(F.lit("none"))) == float("inf")


def test_narrative(spark):
    raw = F.lit("Inactive ingredients: lactose monohydrate; magnesium stearate, water (a, b)\tSTRENGTH\n12\nsugar 5 mg extra")
    rows = one(spark, ingredients.parse_narrative(raw))
    assert [r.display_name for r in rows] == ["lactose monohydrate", "magnesium stearate", "water (a, b)", "sugar"]
    assert rows[0].raw_name == "Inactive ingredients: lactose monohydrate"
    assert (rows[0].normalized_name, rows[0].confidence) == ("Lactose Monohydrate", "low")
    assert rows[3].strength == "5 mg"
    assert one(spark, ingredients.named_entries(F.lit("Sugar; sugar, SALT"))) == ["Sugar", "SALT"]


def test_display_forms(spark):
    name, labeler = text.split_title(F.lit("METFORMIN TABLET [ACME LABS]"))
    assert (one(spark, name), one(spark, labeler)) == ("METFORMIN TABLET", "ACME LABS")
    assert one(spark, text.clean_title(F.lit("o'brien 3m [x] [y]"))) == "O'Brien 3M [X]"
    assert one(spark, text.display_name(F.lit("BAND-AID of The for oral solution"))) == "Band-aid of the for"
    assert one(spark, text.long_date(F.lit("2024-03-05"))) == "March 5, 2024"
    assert one(spark, text.long_date(F.lit("2024-13-05"))) == "2024-13-05"
    assert one(spark, text.primary_active(F.lit("ALPHA BETA; gamma"))) == "Alpha Beta"
    assert one(spark, text.primary_active(F.lit(None).cast("string"))) == "Unknown"


def test_numeric_aware_order(spark):
    rows = spark.createDataFrame([(v,) for v in ("b 10", "B 9", "a 2", "a 10")], "v string")
    assert [r.v for r in rows.orderBy(text.numeric_aware(F.col("v"))).collect()] == ["a 2", "a 10", "B 9", "b 10"]


CONCEPT = "query_id int, rxcui string, name string, tty string, score double, seq bigint"


def _context(spark, raw):
    return queries.normalize_queries(spark.createDataFrame([(1, raw)], "query_id int, raw_text string"))


def test_oral_liquid_ranking(spark):
    rows = spark.createDataFrame(
        [
            (1, "1", "amoxicillin 400 MG/5 mL Oral Suspension", "SCD", 50.0, 0),
            (1, "2", "amoxicillin 400 MG Injection", "SCD", 60.0, 1),
            (1, "3", "amoxicillin", "IN", 20.0, 2),
        ],
        CONCEPT,
    )
    asked = _context(spark, "amoxicillin 400 mg/5 mL suspension")
    out = concepts.resolve(asked, rows.join(asked, "query_id")).orderBy("rank")
    assert [r.rxcui for r in out.collect()] == ["1", "3", "2"]


def test_exact_name_beats_broader_group(spark):
    rows = spark.createDataFrame(
        [(1, "10", "Keppra", "SBD", 15.0, 0), (1, "11", "Keppra Oral Product", "SCDG", 25.0, 1)], CONCEPT
    )
    relations = spark.createDataFrame([("10", "99", "levetiracetam")], "rxcui string, related_rxcui string, related_name string")
    asked = _context(spark, "Keppra")
    out = concepts.resolve(asked, rows.join(asked, "query_id"), relations).orderBy("rank").collect()
    assert out[0].rxcui == "10" and "99" in {r.rxcui for r in out}
    names = concepts.ingredient_names(concepts.resolve(asked, rows.join(asked, "query_id"), relations))
    assert [r.ingredient_name for r in names.collect()] == ["levetiracetam"]


def test_suggestions(spark):
    listed = spark.createDataFrame(
        [
            ("1", 0, "ethanol 0.7 mL/mL Topical Solution", "SCD", 95.0),
            ("2", 1, "hydrogen peroxide 5 MG/mL Topical Solution", "SCD", 90.0),
            ("3", 2, "levetiracetam 100 MG/mL Oral Solution", "SCD", 45.0),
            ("4", 3, "levothyroxine sodium 25 MCG Oral Tablet", "SCD", 40.0),
            ("5", 4, "acetaminophen 160 MG/5 mL Oral Suspension", "SCD", 20.0),
            ("6", 5, "acetaminophen 650 MG Oral Tablet", "SCD", 40.0),
        ],
        "rxcui string, seq bigint, name string, tty string, score double",
    )
    asked = spark.createDataFrame([(1, "lev"), (2, "a"), (3, "acet oral susp")], "query_id int, raw_text string")
    rows = concepts.suggest(asked, listed).orderBy("query_id", F.desc("score")).collect()
    assert [r.rxcui for r in rows if r.query_id == 1] == ["3", "4"]
    assert not [r for r in rows if r.query_id == 2]
    assert [r.rxcui for r in rows if r.query_id == 3][0] == "5"


def test_normal_texts_are_spared_and_others_are_not(spark):
    """The short way for texts that are normal already gives what the replacements give."""
    marks = ["a", "B", "-", " ", "_", "7", "é", "İ", "\n", "%", "\u00a0"]
    texts = [*("".join(t) for n in range(4) for t in itertools.product(marks, repeat=n)), "ab\n", "a b\r", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    blanked = F.regexp_replace(F.lower("t"), r"(?U)[^\p{L}\p{N}_\s-]", " ")
    plain = text.squash(F.regexp_replace(blanked, "-+", "-"))
    assert df.filter(~plain.eqNullSafe(text.normalize_text(F.col("t")))).count() == 0
