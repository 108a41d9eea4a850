"""Label XML, nested archives, ingest stream, changes, index and sinks on small fixtures."""

import io
import json
import os
import re
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelmill import schemas
from labelmill.functions import text
from labelmill.plans import changes, index, pipeline, quality, screener, search, sinks
from labelmill.session import scratch_dir
from labelmill.sources import archive_source, archives, derived, label_xml, landed
from labelmill.streaming import ingest

UNII = "2.16.840.1.113883.4.9"
NDC = "2.16.840.1.113883.6.69"


def ingredient(kind, name, unii, quantity=None):
    amount = ""
    if quantity:
        top, top_unit, bottom, bottom_unit = quantity
        amount = (
            f'<quantity><numerator value="{top}" unit="{top_unit}"/><denominator value="{bottom}" unit="{bottom_unit}"/></quantity>'
        )
    return (
        f'<ingredient classCode="{kind}">{amount}<ingredientSubstance><code code="{unii}" codeSystem="{UNII}"/>'
        f"<name>{name}</name></ingredientSubstance></ingredient>"
    )


def subject(name, form, body, ndc="", route=""):
    code = f'<code code="{ndc}" codeSystem="{NDC}"/>' if ndc else ""
    taken = f'<consumedIn><routeCode displayName="{route}"/></consumedIn>' if route else ""
    return (
        f"<subject><manufacturedProduct><manufacturedProduct><name>{name}</name>"
        f'<formCode displayName="{form}"/>{body}<asContent>{code}</asContent></manufacturedProduct>{taken}</manufacturedProduct></subject>'
    )


def document(body, title="Example Product", labeler="Example Labeler", kind="HUMAN PRESCRIPTION DRUG LABEL", route=""):
    taken = f'<routeCode displayName="{route}"/>' if route else ""
    return (
        f'<document xmlns="urn:hl7-org:v3"><code code="34391-3" displayName="{kind}"/><title>{title}</title><author><assignedEntity>'
        f"<representedOrganization><name>{labeler}</name></representedOrganization></assignedEntity></author>{taken}"
        f"<component><structuredBody>{body}</structuredBody></component></document>"
    )


def section(title, text):
    return f"<component><section><title>{title}</title><text>{text}</text></section></component>"


KEPPRA = document(
    "<component><section>"
    + subject("Keppra", "TABLET, FILM COATED",
              ingredient("ACTIM", "LEVETIRACETAM", "44YRR34555", (250, "mg", 1, 1)) + ingredient("IACT", "MAGNESIUM STEARATE", "70097M6I30"),
              "50474-594-40")
    + subject("Keppra", "SOLUTION",
              ingredient("ACTIM", "LEVETIRACETAM", "44YRR34555", (100, "mg", 1, "mL")) + ingredient("IACT", "GLYCERIN", "PDC6A3C0OX")
              + ingredient("IACT", "maltitol solution", "D65DG142WK"), "50474-001-48")
    + "</section></component>",
    labeler="UCB, INC.", route="ORAL",
)
LEGACY = document(
    "<component><section><subject><manufacturedProduct><manufacturedMedicine><code code='0228-2657'/><name>metformin hydrochloride</name>"
    '<formCode displayName="TABLET"/><activeIngredient><quantity><numerator value="500" unit="mg"/><denominator value="1" unit="1"/>'
    "</quantity><activeIngredientSubstance><code code='786Z46389E'/><name>metformin hydrochloride</name></activeIngredientSubstance>"
    "</activeIngredient><inactiveIngredient><inactiveIngredientSubstance><name>crospovidone</name></inactiveIngredientSubstance>"
    "</inactiveIngredient></manufacturedMedicine></manufacturedProduct></subject></section></component>",
    title='<content styleCode="bold">METFORMIN TABLETS</content>', labeler="Actavis", route="ORAL",
)
TABLE = document(
    section("Active Ingredient/Active Moiety", "<table><tr><th>Active Ingredient</th><th>Strength</th><th>UNII</th></tr>"
            "<tr><td>Acetaminophen (UNII: 362O9ITL9D)</td><td>160 mg/5 mL</td><td>362O9ITL9D</td></tr></table>")
    + section("Inactive Ingredients", "<table><tr><td>first</td><td>1 mg</td><td>abcdefghij</td></tr><tr><td>Ingredient Name</td><td>UNII</td></tr>"
              "<tr><td>Mannitol</td><td>3OWL53L36A</td></tr><tr><td>FD&amp;C Red No. 40</td><td>WZB9127XOA</td></tr></table>"
              "<paragraph>narrative should not win</paragraph>")
)
PARAGRAPHS = document(
    section("INACTIVE INGREDIENTS", "<paragraph>lactose monohydrate</paragraph><paragraph>magnesium stearate (UNII: 70097M6I30)</paragraph>")
    + section("Active ingredients", "<paragraph>metformin hydrochloride 500 mg</paragraph>")
)
NARRATIVE = document(section("Inactive Ingredient", "Contains: water; sugar, salt"))


def docs(spark, *xmls):
    rows = [("a.zip", f"s{i}", i, x) for i, x in enumerate(xmls)]
    df = spark.createDataFrame(rows, "source_file string, setid string, member_seq int, xml string")
    df = df.withColumn("xml_seq", F.lit(0)).withColumn("member", F.col("setid"))
    return label_xml.parse_documents(df)


def test_records_of_two_subjects(spark):
    rows = label_xml.product_records(docs(spark, KEPPRA)).orderBy("subject_seq").collect()
    assert [r.dosage_form for r in rows] == ["TABLET, FILM COATED", "SOLUTION"]
    assert all(r.ndcs == ["50474-594-40", "50474-001-48"] for r in rows)  # codes of the whole document
    assert [r.actives[0].strength for r in rows] == ["250 mg", "100 mg/mL"]
    assert rows[1].inactives[0] == ("GLYCERIN", "glycerin", "PDC6A3C0OX")
    assert (rows[0].labeler, rows[0].product_type) == ("UCB, INC.", "HUMAN PRESCRIPTION DRUG LABEL")


def test_details_of_two_subjects(spark):
    rows = label_xml.all_details(docs(spark, KEPPRA)).orderBy("subject_seq").collect()
    assert [r.product_name for r in rows] == ["Keppra 250 mg TABLET, FILM COATED", "Keppra 100 mg/1 mL SOLUTION"]
    assert [r.ndcs for r in rows] == [["50474-594-40"], ["50474-001-48"]]
    assert all(r.route == "ORAL" and r.product_type is None for r in rows)
    assert [e.display_name for e in rows[1].inactive_ingredients] == ["GLYCERIN", "maltitol solution"]


def test_legacy_layout(spark):
    parsed = docs(spark, LEGACY)
    single = label_xml.single_details(parsed).first()
    assert (single.product_name, single.dosage_form) == ("metformin hydrochloride TABLET", "TABLET")
    assert [e.display_name for e in single.inactive_ingredients] == ["crospovidone"]
    every = label_xml.all_details(parsed).collect()
    assert [r.product_name for r in every] == ["metformin hydrochloride 500 mg TABLET"]
    assert label_xml.product_records(parsed).first().product_name == "Unknown"


def test_section_cascade(spark):
    rows = label_xml.single_details(docs(spark, TABLE, PARAGRAPHS, NARRATIVE)).orderBy("setid").collect()
    active = rows[0].active_ingredients[0]
    assert (active.display_name, active.unii, active.strength) == ("Acetaminophen", "362O9ITL9D", "160 mg/5 mL")
    assert active.raw_name == "Acetaminophen (UNII: 362O9ITL9D) | 160 mg/5 mL | 362O9ITL9D"
    assert [(e.display_name, e.unii, e.source_type) for e in rows[0].inactive_ingredients] == [
        ("first", "ABCDEFGHIJ", "table"), ("Mannitol", "3OWL53L36A", "table"), ("FD&C Red No. 40", "WZB9127XOA", "table"),
    ]
    assert [e.display_name for e in rows[1].inactive_ingredients] == ["lactose monohydrate", "magnesium stearate"]
    assert [e.display_name for e in rows[1].active_ingredients] == ["metformin hydrochloride"]
    assert [(e.display_name, e.confidence) for e in rows[2].inactive_ingredients] == [("water", "low"), ("sugar", "low"), ("salt", "low")]
    assert rows[0].product_name == "Example Product"


def test_section_text(spark):
    parsed = docs(spark, PARAGRAPHS)
    got = parsed.select(label_xml.section_text(F.col("doc"), ["active ingredients"]).alias("t")).first().t
    assert got == "metformin hydrochloride 500 mg"


def test_comparison_on_parsed_details(spark):
    details = label_xml.all_details(docs(spark, KEPPRA))
    results = spark.createDataFrame(
        [(1, "s0", "Keppra [UCB]", None, None, None, ["x"], 0, "r1")],
        "query_id int, setid string, product_name string, labeler string, dosage_form string, route string, ndcs array<string>, seq int, rxcui string",
    )
    rows = search.comparison_rows(results, details, "maltitol", "magnesium").orderBy("subject_seq").collect()
    assert [(r.matched_include_terms, r.matched_exclude_terms, r.matches_filter) for r in rows] == [
        ([], ["magnesium"], False), (["maltitol"], [], True),
    ]
    assert [r.strength_summary for r in rows] == ["250 mg", "100 mg/1 mL"]
    shown = search.matching_rows(search.comparison_rows(results, details), None, None)
    assert shown.count() == 2
    picked = search.product_detail(details, "s0", "50474-001-48").first()
    assert picked.dosage_form == "SOLUTION"
    asked = spark.createDataFrame([(1, "keppra", None, None, None, None)], "query_id int, normalized_text string, ndc string, requested_route string, requested_dose_form string, requested_strength string")
    body = json.loads(search.responses(asked, search.comparison_rows(results, details, "maltitol")).first().body)
    assert len(body["comparison_rows"]) == 2 and len(body["matching_products"]) == 1


# --- archives --------------------------------------------------------------------------


def syrup(name, unii, excipient, kind="HUMAN OTC DRUG LABEL", labeler="Lab"):
    return document(
        "<component><section>"
        + subject(name, "SYRUP", ingredient("ACTIB", name, unii, (5, "mg", 5, "mL")) + ingredient("IACT", excipient, "AAAAAAAAAA"), route="ORAL")
        + "</section></component>", kind=kind, labeler=labeler,
    )


def inner(**files):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, content in files.items():
            z.writestr(name.replace("__", "."), content)
    return buffer.getvalue()


@pytest.fixture()
def zips(tmp_path):
    root = tmp_path / "zips"
    (root / "otc").mkdir(parents=True)
    with zipfile.ZipFile(root / "a.zip", "w") as z:
        z.writestr("p/1.zip", inner(s1__xml=syrup("Alpha", "U1", "Sorbitol"), img__jpg=b"x"))
        z.writestr("p/2.zip", inner(s2__xml=syrup("Alpha", "U1", "water", labeler="Other"), s2_indexingInstructions__xml="<x/>"))
        z.writestr("p/3.zip", b"garbage")
        z.writestr("p/4.zip", inner(s3__xml="<document><broken></document>"))
        z.writestr("p/5.zip", inner(s4__xml=syrup("Vet", "U9", "Xylitol", "VETERINARY LABEL")))
        z.writestr("p/6.zip", inner(s1__xml=syrup("Duplicate", "U1", "Xylitol")))
        z.writestr("p/7.zip", inner(s5__xml=KEPPRA))
        z.writestr("readme.txt", "no label")
    with zipfile.ZipFile(root / "otc" / "b.zip", "w") as z:
        z.writestr("1.zip", inner(s1__xml=syrup("Alpha Two", "U1", "Xylitol")))
        z.writestr("2.zip", inner(s6__xml=syrup("Beta", "U2", "water")))
    (root / "broken.zip").write_bytes(b"not a zip")
    return root


def test_reads_nested_archives(spark, zips):
    listed = archives.list_archives(spark, str(zips))
    assert sorted(r.source_file for r in listed.collect()) == ["a.zip", "b.zip", "broken.zip"]
    members = archives.read_archives(listed).cache()
    labels = archives.labels_only(members).orderBy("path", "member_seq")
    assert [(r.source_file, r.setid) for r in labels.collect()] == [
        ("a.zip", "s1"), ("a.zip", "s2"), ("a.zip", "s3"), ("a.zip", "s4"), ("a.zip", "s1"), ("a.zip", "s5"), ("b.zip", "s1"), ("b.zip", "s6"),
    ]
    failed = archives.read_failures(members).select("source_file", "xml_member_name", "error_type").collect()
    assert sorted(map(tuple, failed)) == [("a.zip", "p/3.zip", "xml_error"), ("broken.zip", "", "archive_error")]
    assert archives.first_xml_per_member(members).count() == 8
    members.unpersist()


def test_ranges_split_an_archive(spark, zips, monkeypatch):
    assert archives.ranges(0, 10) == [(0, None)] == archives.ranges(10, 10)
    assert archives.ranges(21, 10) == [(0, 10), (10, 20), (20, None)]
    listed = archives.list_archives(spark, str(zips))
    whole = sorted(map(tuple, archives.read_archives(listed).collect()), key=str)
    monkeypatch.setattr(archives, "RANGE_BYTES", 500)
    assert archives.read_archives(listed).rdd.getNumPartitions() > 3
    assert sorted(map(tuple, archives.read_archives(listed).collect()), key=str) == whole


@pytest.mark.parametrize("size", [150, archives.RANGE_BYTES])
def test_data_source(spark, zips, size):
    """Whatever the ranges, an archive's members are read once, by the tasks of the ranges that they begin in."""
    archive_source.register(spark)
    source = spark.read.format(archive_source.NAME).option("range_bytes", size)
    read = source.load(f"file:{zips}")
    columns = ["source_file", "member_seq", "xml_seq", "member", "setid", "xml", "error_type"]
    expected = archives.read_archives(archives.list_archives(spark, str(zips))).select(columns)
    assert sorted(map(tuple, read.select(columns).collect()), key=str) == sorted(map(tuple, expected.collect()), key=str)
    a = [r for r in read.withColumn("task", F.spark_partition_id()).collect() if r.source_file == "a.zip"]
    tasks = len({r.task for r in a})
    assert tasks == 1 if size == archives.RANGE_BYTES else 1 < tasks <= 7


def test_data_source_makes_the_columns_of_its_schema(spark, zips, tmp_path, monkeypatch):
    archive_source.register(spark)
    source = lambda: spark.read.format(archive_source.NAME)
    rows = source().schema("setid string, xml_seq int").load(str(zips)).filter("setid IS NOT NULL").collect()
    assert sorted(map(tuple, rows)) == [(s, 0) for s in ("s1", "s1", "s1", "s2", "s3", "s4", "s5", "s6")]
    # nothing is unpacked for them
    monkeypatch.setattr(zipfile.ZipFile, "read", lambda *a, **k: pytest.fail("unpacked"))
    inner_bytes = inner(s1__xml="<document/>")
    assert [r[1] for r in archives._label_xmls(inner_bytes, whole=False)] == ["s1.xml"]
    monkeypatch.undo()
    assert source().option("pattern", "b*.zip").load(str(zips)).filter("error_type IS NULL").count() == 2
    assert source().option("recursive", "false").load(str(zips)).filter("source_file = 'b.zip'").count() == 0
    (tmp_path / "none").mkdir()
    assert source().load(str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="no columns"):
        source().schema("pages int").load(str(zips)).collect()


def test_stream_source_takes_late_files_once(spark, zips, tmp_path):
    archive_source.register(spark)
    table, check = str(tmp_path / "members"), str(tmp_path / "check")

    def run():
        members = spark.readStream.format(archive_source.NAME).option("range_bytes", 1000).load(str(zips))
        write = members.writeStream.format("parquet").option("path", table).option("checkpointLocation", check)
        write.trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.schema(schemas.MEMBER).parquet(table).filter("error_type IS NULL").collect()
        return sorted((r.source_file, r.setid) for r in rows)

    first = run()
    assert len(first) == 8 and run() == first
    with zipfile.ZipFile(zips / "late.zip", "w") as z:
        z.writestr("1.zip", inner(s8__xml="<document/>"))
    os.utime(zips / "late.zip", (1_000_000_000, os.stat(zips / "a.zip").st_mtime - 3600))
    assert run() == sorted([*first, ("late.zip", "s8")]) == run()


def test_offsets_stay_small():
    week = archive_source.WEEK
    file = archive_source.File
    start, end = {"until": -1, "seen": {}}, {"until": 10 * week, "seen": {"new": 10 * week}}
    assert archive_source.done(end, file("old", 1, 9 * week), week) and archive_source.done(end, file("new", 1, 10 * week), week)
    assert not archive_source.done(end, file("late", 1, 9 * week + 1), week) and not archive_source.done(start, file("old", 1, 0), week)


def test_ingest_stream_and_resume(spark, zips, tmp_path):
    tables, check = str(tmp_path / "tables"), str(tmp_path / "check")
    ingest.ingest_archives(spark, str(zips), tables, check, max_archives=1).awaitTermination()
    log = spark.read.parquet(f"{tables}/processing_log").filter("status <> 'started'").collect()
    assert {r.source_file: r.status for r in log} == {"a.zip": "success", "b.zip": "success", "broken.zip": "failed"}
    message = next(r.message for r in log if r.source_file == "a.zip")
    # the tablet is excluded, the label without products counts as a parse error
    assert message == "high=1, moderate=1, review=0, excluded=2, spls=4, parse_errors=1"
    failures = spark.read.parquet(f"{tables}/qa_parse_failures").collect()
    assert sorted(r.error_type for r in failures) == ["archive_error", "parse_error", "xml_error"]
    products = {r.spl_setid: r for r in ingest.current_products(spark, tables).collect()}
    assert set(products) == {"s1", "s2", "s5"}
    assert products["s2"].concern_tier == "alternative"
    # the last written batch decides which version of s1 is stored
    last = max((r.batch_id, r.source_file) for r in spark.read.parquet(f"{tables}/products").filter("spl_setid = 's1'").collect())
    assert products["s1"].matched_sugar_alcohols == {"a.zip": "sorbitol", "b.zip": "xylitol"}[last[1]]
    assert products["s2"].alternative_sugar_alcohols == products["s1"].matched_sugar_alcohols
    # nothing new: a second run adds no batch; one more archive is picked up alone
    with zipfile.ZipFile(zips / "c.zip", "w") as z:
        z.writestr("1.zip", inner(s7__xml=syrup("Beta Two", "U2", "D-Mannitol")))
    ingest.ingest_archives(spark, str(zips), tables, check).awaitTermination()
    products = {r.spl_setid: r.concern_tier for r in ingest.current_products(spark, tables).collect()}
    assert (products["s7"], products["s6"]) == ("high", "alternative")
    assert spark.read.parquet(f"{tables}/products").filter("source_file = 'a.zip'").select("batch_id").distinct().count() == 1
    ingest.compact(spark, f"{tables}/products", f"{tables}/products_compact", ["spl_setid"], ["batch_id", "member_seq", "subject_seq"])
    assert spark.read.parquet(f"{tables}/products_compact").count() == 3


def test_pending_archives(spark):
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "source_file string")
    log = spark.createDataFrame([("a", "success"), ("b", "started"), ("b", "failed")], "source_file string, status string")
    assert sorted(r.source_file for r in pipeline.pending_archives(files, log).collect()) == ["b", "c"]


def test_single_label_files(spark, tmp_path):
    (tmp_path / "abc.xml").write_text(KEPPRA)
    rows = archives.read_label_files(spark, str(tmp_path)).collect()
    assert [(r.setid, r.xml) for r in rows] == [("abc", KEPPRA)]


# --- label changes -----------------------------------------------------------------------


def test_pairs_are_greedy(spark):
    lines = ["Boxed Warning", "Warnings (5.1)", "01/2024", "02/2024", "Dosage (2)", " 3/2023 ", "tail"]
    rows = spark.createDataFrame([(lines,)], "lines array<string>").select(changes.pair_lines(F.col("lines")).alias("p")).first().p
    assert [tuple(r) for r in rows] == [("Warnings (5.1)", "01/2024"), ("02/2024", "Dosage (2)")][:1] + [("Dosage (2)", "3/2023")]


def test_recent_dates(spark):
    rows = spark.createDataFrame([("seen 12/2023 and 3/2024",), ("13/2024",), ("02/2024",)], "d string")
    got = rows.select(changes.is_recent(F.col("d"), F.lit("2024-03-01").cast("date")).alias("r")).collect()
    assert [r.r for r in got] == [True, False, False]


def test_word_diff_of_listed_sections(spark):
    sections = spark.createDataFrame(
        [("s", 1, "Warnings and Precautions", "old a & b"), ("s", 3, "Warnings and Precautions", "new a & b <c>"),
         ("s", 1, "Overdosage", "x"), ("s", 3, "Overdosage", "y"), ("s", 3, "Contraindications", "added")],
        "setid string, version int, name string, section_text string",
    )
    listed = spark.createDataFrame(
        [("s", 3, "Warnings and Precautions (5.2)", "01/2024"), ("s", 3, "Contraindications (4)", "01/2024")],
        "setid string, version int, rmc_section string, rmc_date string",
    )
    versions = spark.createDataFrame([("s", 1, "34391-3"), ("s", 3, "34391-3")], "setid string, version int, doc_code string")
    versions = versions.withColumn("published_date", F.lit("2024-02-01").cast("date"))
    found = changes.with_previous_version(versions).filter("version > 1")
    diffs = changes.section_diffs(changes.changed_sections(found, sections, listed)).orderBy("name").collect()
    assert [(d.name, d.inline_html) for d in diffs] == [
        ("Contraindications", "<ins>added</ins>"),
        ("Warnings and Precautions", "<del>old</del><ins>new</ins> a &amp; b <ins>&lt;c&gt;</ins>"),
    ]
    day = F.lit("2024-02-01").cast("date")
    report = changes.label_changes(versions, sections, listed, day, day).collect()
    assert [(r.version, r.previous_version, r.rmc_count, r.diff_count) for r in report] == [(3, 1, 2, 2)]
    late = changes.label_changes(versions, sections, listed, day, day, lookback_cutoff=F.lit("2024-02-01").cast("date"))
    assert late.count() == 0


# --- index and sinks -----------------------------------------------------------------------


def test_index_round_trip(spark, tmp_path):
    parsed = docs(spark, KEPPRA, syrup("Alpha", "U1", "Sorbitol"), syrup("ALPHA", "U1", "glycerin"))
    evaluated = index.evaluate(label_xml.all_details(parsed))
    labels = parsed.select("source_file")
    sinks.write_index(evaluated, labels, str(tmp_path / "index"), ["member_seq", "subject_seq"])
    rows = index.read_index(spark, str(tmp_path / "index" / "groups")).orderBy("setid").collect()
    assert [(r.ingredient_name, r.setid, r.concern_tier) for r in rows] == [
        ("LEVETIRACETAM", "s0", "moderate"), ("Alpha", "s1", "high"), ("Alpha", "s2", "moderate"),
    ]
    meta = spark.read.json(str(tmp_path / "index" / "metadata")).first()
    assert (meta.spl_count, meta.total, meta.tier_counts.high) == (3, 3, 1)
    nested = {
        "built_at": "2024-01-02T03:04:05+00:00", "source_files": ["a.zip"], "groups": [
            {"ingredient_name": "X", "products": [{"product_name": "n", "setid": "s", "active_ingredient": "X"}]}],
    }
    (tmp_path / "nested.json").write_text(json.dumps(nested, indent=1))
    row = index.read_index(spark, str(tmp_path / "nested.json")).first()
    assert (row.setid, row.concern_tier, row.ndcs) == ("s", "high", [])
    assert index.read_index_metadata(spark, str(tmp_path / "nested.json")).first().total == 1
    sinks.write_index_csvs(evaluated, str(tmp_path / "csv"))
    header = spark.read.csv(str(tmp_path / "csv" / "high_concern"), header=True)
    assert header.columns[:3] == ["product_name", "setid", "labeler"] and header.count() == 1


def test_tables_and_csvs(spark, tmp_path):
    parsed = docs(spark, syrup("Alpha", "U1", "Sorbitol"), syrup("Alpha", "U1", "water", labeler="Other"), KEPPRA)
    rows = label_xml.product_records(parsed)
    products = pipeline.tier_products(rows, ["member_seq", "subject_seq"], include_excluded=True)
    products = products.withColumn("processed_at", F.lit("2024-01-01T00:00:00+00:00"))
    sinks.write_products(products, str(tmp_path / "products"))
    back = screener.read_products(spark, str(tmp_path / "products"))
    assert back.filter("concern_tier = 'high'").count() == 1
    old = back.drop("alternative_sugar_alcohols", "active_strength")
    sinks.write_table(old, str(tmp_path / "old"))
    assert "alternative_sugar_alcohols" in screener.read_products(spark, str(tmp_path / "old")).columns
    sinks.write_tier_csvs(back, str(tmp_path / "csv"), include_excluded=True)
    high = spark.read.csv(str(tmp_path / "csv" / "final_products_of_concern"), header=True)
    assert high.columns[0] == "spl_setid" and high.count() == 1
    assert not (tmp_path / "csv" / "alternative").exists()
    # the excluded row of s1 is stored, so its setid is not replaced by the alternative
    assert {r.spl_setid: r.concern_tier for r in back.collect()}["s1"] == "excluded"


def test_report_pack(spark, tmp_path):
    parsed = docs(spark, syrup("Alpha", "U1", "Sorbitol"), "<broken", syrup("Vet", "U9", "Xylitol", "VETERINARY LABEL"))
    assessed = pipeline.assess(label_xml.product_records(parsed))
    products = pipeline.tiered_rows(assessed, ["member_seq"]).withColumn("processed_at", F.lit("now"))
    sinks.write_quality_reports(
        assessed, label_xml.labels_read(parsed), label_xml.parse_failures(parsed), products, str(tmp_path)
    )
    stages = {r.stage: int(r["count"]) for r in spark.read.csv(str(tmp_path / "qa_funnel_summary"), header=True).collect()}
    assert (stages["total_xml_files"], stages["parse_failures"], stages["non_human_skipped"], stages["final_high"]) == (3, 1, 1, 1)
    assert spark.read.csv(str(tmp_path / "qa_samples"), header=True).filter("bucket = 'included'").count() == 1
    assert spark.read.csv(str(tmp_path / "broad_recall_products"), header=True).columns[-1] == "source_file"


def test_known_positive_file(spark, tmp_path):
    (tmp_path / "known.csv").write_text(
        "expected_product_name,expected_setid,expected_excipient,expected_decision,notes\n"
        "Alpha,,sorbitol,high,by name\n,s0,xylitol,,by id\nNobody,,,,\nAlpha,,,moderate,\n"
    )
    parsed = docs(spark, syrup("Alpha", "U1", "Sorbitol"))
    products = pipeline.tiered_rows(pipeline.assess(label_xml.product_records(parsed)), ["member_seq"])
    expected = quality.read_known_positives(spark, str(tmp_path / "known.csv"))
    got = quality.known_positive_outcomes(expected, products, ["member_seq"]).collect()
    assert sorted(r.outcome for r in got) == ["FAIL_EXCIPIENT", "FAIL_TIER", "MISSING", "PASS"]


def test_candidate_file(spark, tmp_path):
    (tmp_path / "ok.json").write_text(json.dumps([{"setid": " s ", "product_name": "n", "ndc": ""}], indent=2))
    (tmp_path / "bad.json").write_text("{not json")
    row = landed.read_candidates(spark, str(tmp_path / "ok.json")).collect()
    assert [(r.setid, r.ndc) for r in row] == [("s", None)]
    assert landed.read_candidates(spark, str(tmp_path / "bad.json")).count() == 0


def test_related_payloads(spark):
    payload = json.dumps({"relatedGroup": {"conceptGroup": {"tty": "IN", "conceptProperties": [
        {"rxcui": "1", "name": "a"}, {"rxcui": "1", "name": "again"}, {"rxcui": "", "name": "b"}]}}})
    rows = spark.createDataFrame([(7, payload)], "q int, payload string")
    assert [(r.rxcui, r.name, r.tty) for r in landed.related_concepts(rows, ["q"]).collect()] == [("1", "a", "IN")]


def test_small_archives_share_tasks(spark):
    small = spark.createDataFrame([(f"/none/{i}.zip", 10) for i in range(500)], "path string, length bigint")
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert archives.read_archives(small).rdd.getNumPartitions() <= spread
    large = spark.createDataFrame([("/none/l.zip", 500 * archives.RANGE_BYTES)], "path string, length bigint")
    assert archives.read_archives(large).rdd.getNumPartitions() == 500


def test_small_ranges_share_partitions():
    from pyspark.sql.types import StringType, StructType

    from labelmill.sources import archive_source

    options = archive_source._Options({"path": "/none", "range_bytes": "100"}, StructType().add("setid", StringType()))
    files = [archive_source.File(f"/none/{i}.zip", 150, 0) for i in range(2000)]
    parts = options.partitions(files)
    assert len(parts) <= 2 * archive_source.SPREAD
    held = [(r.path, r.low, r.high) for p in parts for r in p.ranges]
    assert held == [(f.path, low, high) for f in files for low, high in ((0, 100), (100, None))]
    assert len(options.partitions(files[:100])) == 200


def test_archived_labels_are_rendered_once(spark, sf_dir, monkeypatch):
    from catalog import archived

    plans = []

    def planned(files, folder):
        plans.append(files._jdf.queryExecution().optimizedPlan().toString())
        return spark.range(1).select(F.col("id").alias("members"))

    monkeypatch.setattr(archived.archives, "write_archives", planned)
    archived.written(spark, sf_dir)
    assert plans[0].count("Window ") == 1


def test_distinct_entries_build_their_items_once(spark):
    kept = text.keep_first_by(F.transform("x", F.upper), F.lower, F.array().cast("array<string>"))
    rows = spark.range(1).select(F.array(F.lit("a"), F.lit("B"), F.lit("A"), F.col("id").cast("string")).alias("x")).select(kept.alias("k"))
    assert rows.first()["k"] == ["A", "B", "0"]
    assert rows._jdf.queryExecution().analyzed().toString().count("upper(") == 1


def test_ndcs_are_those_of_the_pattern():
    for shown in ("1234-567-8", "x1234-567-8 12345-6789-01", "12345-123-12-1234-123-1", "123456-123-1", "1234-567-891", "0001-222-33,0001-222-33", ""):
        assert label_xml._ndcs_anywhere(shown) == label_xml._NDC_ANYWHERE.findall(shown)


def test_concepts_of_many_queries_are_not_broadcast(spark):
    candidates = spark.range(4).select(F.col("id").alias("query_id"), F.lit("c1").alias("rxcui"))
    products = spark.createDataFrame([("s1", "c1"), ("s2", "c1"), ("s3", "c2")], "setid string, rxcui string")
    found = search.products_by_concept(candidates, products)
    assert sorted((r.query_id, r.setid) for r in found.collect()) == [(q, s) for q in range(4) for s in ("s1", "s2")]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_documents_are_read_in_slices_of_bounded_bytes(spark):
    batch = pa.array(["<a/>" * n for n in (1, 1, 600, 1, 2)] + [None, "", "x" * 10])
    slices = [s.to_pylist() for s in label_xml._slices(batch, most=20)]
    assert [x for s in slices for x in s] == batch.to_pylist()
    assert all(len(s) == 1 or sum(len(x or "") for x in s) <= 20 for s in slices) and len(slices) == 4
    assert not list(label_xml._slices(pa.array([], pa.string())))
    rows = spark.range(700).selectExpr("id", "if(id % 3 = 0, null, concat('<document xmlns=\"urn:hl7-org:v3\"><title>', id, '</title></document>')) AS xml")
    read = {r.id: r.title for r in label_xml.parse_documents(rows).select("id", "doc.title").collect()}
    assert read == {i: None if i % 3 == 0 else str(i) for i in range(700)}
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8 << 20


def test_reports_leave_nothing_staged_and_shuffle_no_xml(spark, sf_dir):
    from catalog import archived

    before = set(os.listdir(os.path.dirname(scratch_dir(spark, "none"))))
    folder = archived._reports(spark, sf_dir)
    made = set(os.listdir(os.path.dirname(folder))) - before
    assert made == {os.path.basename(folder)}
    files = spark.createDataFrame([("b.zip", "m", "m.xml", b"x"), ("a.zip", "m", "m.xml", b"y")], "archive string, member string, name string, content binary")
    gathered = archives.write_archives(archives.gathered(files.coalesce(1)), f"{folder}/gathered")
    assert "Exchange" not in gathered._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in gathered.collect()) == [("a.zip", 1), ("b.zip", 1)]


def test_assessed_records_are_tiered_without_staging(spark, sf_dir):
    from catalog import tiering

    records = tiering.records(spark, sf_dir)
    one = pipeline.tier_products(records, ["subject_seq"])
    other = pipeline.tier_assessed(pipeline.assess(records), ["subject_seq"])
    assert sorted(one.columns) == sorted(other.columns)
    other = other.select(one.columns)
    assert one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty()


def test_unwanted_product_columns_are_not_staged(spark, monkeypatch):
    """A caller of few columns has the same rows and stages what they need only."""
    inactives = lambda *names: [(n, n.lower(), "U2") for n in names]
    rows = [
        ("s1", 0, "A", "L", "SYRUP", "ORAL", None, ["1"], [("x", "1 mg", "U1")], inactives("Sorbitol", "water"), "z"),
        ("s1", 1, "A", "L", "SYRUP", "ORAL", None, ["1"], [("x", "1 mg", "U1")], inactives("water"), "z"),
        ("s2", 0, "B", "L", "SYRUP", "ORAL", None, ["2"], [("x", "1 mg", "U1")], inactives("water"), "z"),
        ("s3", 0, None, None, None, None, None, None, None, None, None),
    ]
    schema = (
        "setid string, subject_seq int, product_name string, labeler string, dosage_form string, route string, product_type string, "
        "ndcs array<string>, actives array<struct<name:string,strength:string,unii:string>>, "
        "inactives array<struct<raw_name:string,normalized_name:string,unii:string>>, source_file string"
    )
    records, staged = spark.createDataFrame(rows, schema), []
    whole = pipeline.stage
    monkeypatch.setattr(pipeline, "stage", lambda df, *more: staged.append(set(df.columns)) or whole(df, *more))
    wanted = ["spl_setid", "concern_tier", "alternative_sugar_alcohols"]
    few = pipeline.tier_products(records, columns=wanted)
    assert few.columns == wanted and staged and not any("ndcs" in c or "inactive_ingredients_raw" in c for c in staged)
    assert sorted(map(str, few.collect())) == sorted(map(str, pipeline.tier_products(records).select(*wanted).collect()))
    assert {r["spl_setid"]: r["concern_tier"] for r in few.collect()} == {"s1": "high", "s2": "alternative"}


def test_parts_go_to_gathered_labels(spark, tmp_path):
    """Gathered labels are not dealt out again for their part; null order keys, missing and repeated parts are as in a plain join."""
    lines = [(1, 5, n, n, 1.0, "d") for n in range(10)] + [(1, None, 1, 1, 1.0, "d"), (1, derived.ORDER_SPAN, 1, 1, 1.0, "d")]
    lines += [(2, 7, 1, 1, 1.0, "d"), (2, None, None, 1, None, None), (3, 1, 1, 1, 1.0, "d"), (None, 1, 1, 1, 1.0, "d")]
    schema = "l_partkey long, l_orderkey long, l_linenumber int, l_suppkey long, l_extendedprice double, l_shipdate string"
    spark.createDataFrame(lines, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    parts = [(1, "one", "b"), (2, "two", "b"), (2, "other", "b"), (9, "none", "b"), (None, "null", "b")]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    rows = derived.label_records(spark, str(tmp_path))
    found = sorted((r.setid, r.product_name, len(r.actives) + len(r.inactives)) for r in rows.collect())
    one = [("set-1-0", "one", 1), ("set-1-0-0", "one", 8), ("set-1-0-1", "one", 2), ("set-1-1-0", "one", 1)]
    two = [(f"set-2-{s}", name, 1) for s in ("0", "0-0") for name in ("other", "two")]
    assert found == sorted(one + two)
    assert derived.label_lines(spark, str(tmp_path)).filter("span IS NULL").count() == 2
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = derived.label_records(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert re.search(r"SortMergeJoin \[l_partkey#\d+L, span#\d+L\], \[l_partkey#\d+L, span#\d+L\]", plan)


def test_archives_are_packed_as_zipfile_reads_them(monkeypatch):
    files = [("a.xml", b"x" * 5000), ("é/ü.xml", b""), ("b", bytes(range(256)) * 10)]
    for most in (archives.PACKED, (0, 0, 0)):  # directly, by zipfile
        monkeypatch.setattr(archives, "PACKED", most)
        with zipfile.ZipFile(io.BytesIO(archives.packed(files))) as z:
            assert z.testzip() is None and [(n, z.read(n)) for n in z.namelist()] == files
            assert {i.compress_type for i in z.infolist()} == {zipfile.ZIP_DEFLATED}
        with zipfile.ZipFile(io.BytesIO(archives.packed([]))) as z:
            assert z.namelist() == []


def test_members_are_checked_without_their_text(spark, zips):
    """Without ``xml`` only the asked columns come, and damage inside an XML is a failure still."""
    columns = ["source_file", "member", "setid", "xml_seq", "error_type"]
    data = bytearray(inner(s9__xml="<document>" + "text " * 400 + "</document>"))
    data[60:64] = b"\xff\x00\xff\x00"
    with zipfile.ZipFile(zips / "c.zip", "w") as z:
        z.writestr("1.zip", bytes(data))
    listed = archives.list_archives(spark, str(zips))
    names = archives.read_archives(listed, columns=columns)
    assert sorted(names.columns) == sorted(columns)
    whole = archives.read_archives(listed).select(*columns)
    assert sorted(map(str, names.select(*columns).collect())) == sorted(map(str, whole.collect()))
    assert [r.error_type for r in names.filter("source_file = 'c.zip'").collect()] == ["read_error"]


def test_archives_are_parsed_where_they_are_read(spark, zips):
    listed = archives.list_archives(spark, str(zips))
    one = label_xml.parse_archives(listed, "records")
    other = label_xml.parse_documents(archives.read_archives(listed), "records")
    assert one.dtypes == other.dtypes
    assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert "xml#" not in plan and plan.count("MapInArrow") == 1
    # only a mark of every document is shuffled for the labels that gave nothing
    read = archives.labels_only(one)
    marks = label_xml.first_labels_read(read)
    assert sorted(map(str, marks.collect())) == sorted(map(str, label_xml.labels_read(label_xml.first_label_per_archive(read)).collect()))
    below = marks._jdf.queryExecution().optimizedPlan().toString().split("Window", 1)[1].splitlines()
    assert "doc#" not in below[0] and any("subjects" in line and "Project" in line for line in below)


def test_many_asks_are_not_broadcast(spark):
    """Queries that grow with the data do not go through the driver, nor do the products that they are joined to."""
    raw = spark.range(40).select(F.col("id").alias("query_id"), F.concat(F.lit("alpha syrup "), (F.col("id") % 2).cast("string")).alias("raw_text"))
    raw = raw.unionByName(spark.createDataFrame([(100, "0002-1234-01 beta")], "query_id long, raw_text string"))
    rows = [(f"s{i}", f"Alpha {i % 2} SYRUP", "l", "SYRUP", "ORAL", ["0002-1234-01"] if i == 3 else [], i) for i in range(6)]
    listings = spark.createDataFrame(rows, "setid string, product_name string, labeler string, dosage_form string, route string, ndcs array<string>, seq int")
    found = search.broad_search(raw, listings)
    hits = sorted((r.query_id, r.setid) for r in found.collect())
    assert hits == sorted([(q, f"s{i}") for q in range(40) for i in range(6) if i % 2 == q % 2] + [(100, "s3")])
    joined = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line and "_salt" in line]
    assert joined and all("SortMergeJoin" in line for line in joined)
