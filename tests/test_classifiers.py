"""Case tables of the form, route and matcher checks."""

from pyspark.sql import functions as F

from labelmill.operators import classify, match
from labelmill.plans import quality

# --- Fixed values: the cases of the form, route and matcher checks ---------------
FORM_CASES = [
    ("SOLUTION", "strong"), ("SUSPENSION", "strong"), ("SYRUP", "strong"), ("ELIXIR", "strong"),
    ("CONCENTRATE", "strong"), ("ORAL DROPS", "strong"), ("ORAL SOLUTION", "strong"), ("ORAL SUSPENSION", "strong"),
    ("LIQUID", "ambiguous"), ("DROPS", "ambiguous"), ("EMULSION", "ambiguous"), ("CAPSULE", "excluded"),
    ("CAPSULE LIQUID FILLED", "excluded"), ("TABLET", "excluded"), ("TABLET FILM COATED", "excluded"),
    ("INJECTION", "excluded"), ("OPHTHALMIC SOLUTION", "excluded"), ("TOPICAL SOLUTION", "excluded"),
    ("GEL", "non_liquid"), ("POWDER", "non_liquid"), ("CREAM", "non_liquid"), (None, "non_liquid"), ("", "non_liquid"),
]
ROUTE_CASES = [
    ("ORAL", "oral"), ("ENTERAL", "oral"), ("GASTRIC", "oral"), ("NASOGASTRIC", "oral"), ("BUCCAL", "oral"),
    ("SUBLINGUAL", "oral"), ("OROPHARYNGEAL", "oral"), ("TOPICAL", "excluded"), ("OPHTHALMIC", "excluded"),
    ("NASAL", "excluded"), ("RECTAL", "excluded"), ("INHALATION", "excluded"), ("INTRAVENOUS", "excluded"),
    ("INTRAMUSCULAR", "excluded"), (None, "blank"), ("", "blank"), ("  ", "excluded"), ("DENTAL", "excluded"),
    ("PARENTERAL", "oral"),
]
HITS = [
    "SORBITOL", "Sorbitol solution", "NONCRYSTALLIZING SORBITOL SOLUTION", "non-crystallizing sorbitol solution",
    "mannitol", "D-Mannitol", "xylitol", "maltitol", "Maltitol Solution", "lactitol", "lactitol monohydrate", "isomalt",
]
MISSES = ["sorbitan monostearate", "sucralose", "glycerin", "cellulose", "sodium benzoate"]


def _check(rows, expected, actual):
    checked = quality.check_cases(rows, expected, actual)
    assert quality.all_passed(checked).first()[0], checked.filter("result = 'FAIL'").collect()


def test_form_cases(spark):
    rows = spark.createDataFrame(FORM_CASES, "dosage_form string, expected string").withColumn("route", F.lit("ORAL"))
    _check(classify.classify_form_and_route(rows), "expected", "form_class")


def test_route_cases(spark):
    rows = spark.createDataFrame(ROUTE_CASES, "route string, expected string").withColumn("dosage_form", F.lit("SYRUP"))
    _check(classify.classify_form_and_route(rows), "expected", "route_class")


def test_evidence_columns(spark):
    rows = spark.createDataFrame(
        [("CAPSULE, LIQUID FILLED", "ORAL"), ("ORAL DROPS", "DENTAL"), ("ORAL SOLUTION", "NASOGASTRIC")],
        "dosage_form string, route string",
    )
    got = classify.classify_form_and_route(rows).select(
        "included_form_match", "excluded_form_match", "included_route_match", "excluded_route_match", "should_process"
    )
    assert [tuple(r) for r in got.collect()] == [
        (None, "capsule, liquid filled", "oral", None, False),
        ("oral drops", None, None, "DENTAL", False),
        ("oral solution", None, "nasogastric", None, True),
    ]


def _inactives(names):
    return F.array(
        *[F.struct(F.lit(n).alias("raw_name"), F.lower(F.lit(n)).alias("normalized_name"), F.lit(None).cast("string").alias("unii")) for n in names]
    )


def test_matcher_cases(spark):
    cases = [(n, True) for n in HITS] + [(n, False) for n in MISSES]
    rows = spark.createDataFrame(cases, "raw_name string, expected boolean")
    one = F.array(F.struct("raw_name", F.lower("raw_name").alias("normalized_name"), F.lit(None).cast("string").alias("unii")))
    _check(rows.withColumn("got", F.size(match.match_concepts(one)) > 0), "expected", "got")


def test_first_ingredient_per_concept_in_vocabulary_order(spark):
    items = _inactives(["Xylitol", "D-Mannitol", "Sorbitol Solution 70%", "sorbitol", "GLYCERINE"])
    row = spark.range(1).select(match.match_concepts(items).alias("a"), match.match_concepts(items, "app").alias("b")).first()
    assert [(m.canonical_name, m.raw_name, m.category) for m in row.a] == [
        ("sorbitol", "Sorbitol Solution 70%", "high"), ("mannitol", "D-Mannitol", "high"), ("xylitol", "Xylitol", "moderate"),
    ]
    assert [(m.canonical_name, m.matched_term) for m in row.b][0] == ("sorbitol", "sorbitol solution")
    assert [(m.canonical_name, m.matched_term) for m in row.b][-1] == ("glycerin", "glycerine")
