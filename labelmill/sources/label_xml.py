"""Label XML to nested columns, and nested columns to product records.

One Arrow-batched function pulls the raw fields out of a document; every rule
about them (names, strengths, codes, sections, fallbacks) is a column
expression on the resulting arrays.
"""

from __future__ import annotations

import gc
import re
import xml.etree.ElementTree as ET
from collections import defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from labelmill import schemas, vocab
from labelmill.functions import ingredients, text
from labelmill.operators.ordered import first_per_key
from labelmill.sources import archives

#: Bytes of one Arrow batch, and of XML whose fields are held as Python objects at a time.
BATCH_BYTES, SLICE_BYTES = 2 << 20, 256 << 10

_NS = "{" + vocab.HL7_NAMESPACE + "}"
_NDC_ANYWHERE = re.compile(r"\b\d{4,5}-\d{3,4}-\d{1,2}\b")
_NDC_MIDDLE = re.compile(r"-\d{3,4}-\d")
_NDC_SHAPE = re.compile(vocab.NDC_PATTERN)


_CODE, _NAME, _FORM, _ROUTE, _TITLE = (_NS + n for n in ("code", "name", "formCode", "routeCode", "title"))
_INGREDIENT, _QUANTITY, _NUMERATOR, _DENOMINATOR = (_NS + n for n in ("ingredient", "quantity", "numerator", "denominator"))
_SUBJECT, _PRODUCT, _MEDICINE = (_NS + n for n in ("subject", "manufacturedProduct", "manufacturedMedicine"))
_AUTHOR, _ENTITY, _ORG = (_NS + n for n in ("author", "assignedEntity", "representedOrganization"))
_SUBSTANCES = {None: _NS + "ingredientSubstance", **{r: f"{_NS}{r}IngredientSubstance" for r in ("active", "inactive")}}
_LEGACY = {r: f"{_NS}{r}Ingredient" for r in ("active", "inactive")}
_LAYOUTS = [head + (_PRODUCT, inner) for head in ((_SUBJECT,), ()) for inner in (_PRODUCT, _MEDICINE)]


def _below(root: ET.Element) -> dict[str, list[ET.Element]]:
    """The elements under the root by tag, in document order."""
    below = defaultdict(list)
    for element in root.iter():
        if element is not root:
            below[element.tag].append(element)
    return below


def _first(elements: Sequence[ET.Element], *steps: str) -> ET.Element | None:
    """First element at the end of a path of children, in document order."""
    if not steps:
        return elements[0] if elements else None
    for element in elements:
        found = element.find(steps[0]) if len(steps) == 1 else _first(element.findall(steps[0]), *steps[1:])
        if found is not None:
            return found
    return None


def _first_under(element: ET.Element, tag: str) -> ET.Element | None:
    return next((e for e in element.iter(tag) if e is not element), None)


def _text(element: ET.Element | None) -> str | None:
    return None if element is None else element.text or ""


def _local(element: ET.Element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _attr(element: ET.Element | None, name: str) -> str | None:
    return None if element is None else element.get(name)


def _flat(element: ET.Element) -> str:
    pieces = (" ".join(t.split()) for t in element.itertext())
    return "\n".join(p for p in pieces if p)


def _ingredient(node: ET.Element, legacy: str | None, direct: bool) -> dict:
    substance = node.find(_SUBSTANCES[legacy])
    quantities = node.findall(_QUANTITY)
    numerator, denominator = _first(quantities, _NUMERATOR), _first(quantities, _DENOMINATOR)
    codes = [] if substance is None else substance.findall(_CODE)
    return {
        "class_code": node.get("classCode"),
        "legacy_role": legacy,
        "direct": direct,
        "name": None if substance is None else substance.findtext(_NAME),
        "has_substance": substance is not None,
        "codes": [{"code": c.get("code"), "system": c.get("codeSystem")} for c in codes],
        "num_value": _attr(numerator, "value"),
        "num_unit": _attr(numerator, "unit"),
        "den_value": _attr(denominator, "value"),
        "den_unit": _attr(denominator, "unit"),
    }


def _ingredients(root: ET.Element) -> list[dict]:
    children = set(root.findall(_INGREDIENT))
    found = [_ingredient(n, None, n in children) for n in root.iter(_INGREDIENT)]
    for role, tag in _LEGACY.items():
        found += [_ingredient(n, role, False) for n in root.iter(tag)]
    return found


def _subject(node: ET.Element, container: ET.Element, at: int, kind: str, nth: int) -> dict:
    return {
        "container": at,
        "kind": kind,
        "nth": nth,
        "name": node.findtext(_NAME),
        "form": _attr(node.find(_FORM), "displayName"),
        "route": _attr(_first_under(node, _ROUTE), "displayName"),
        "container_route": _attr(_first_under(container, _ROUTE), "displayName"),
        "ndc_codes": [c for c in (e.get("code", "").strip() for e in node.iter(_CODE)) if _NDC_SHAPE.match(c)],
        "ingredients": _ingredients(node),
    }


def _subjects(below: dict[str, list[ET.Element]]) -> list[dict]:
    found = []
    for at, container in enumerate(c for s in below[_SUBJECT] for c in s.findall(_PRODUCT)):
        nth = {"manufacturedProduct": 0, "manufacturedMedicine": 0}
        for child in container:
            if _local(child) in nth:
                found.append(_subject(child, container, at, _local(child), nth[_local(child)]))
                nth[_local(child)] += 1
        if container.find(_PRODUCT) is None:
            found.append(_subject(container, container, at, "container", 0))
    return found


def _ndcs_anywhere(xml: str) -> list[str]:
    """All matches of ``_NDC_ANYWHERE``, looked for at the hyphens: a search at every character costs a third of a document."""
    found, done, at = [], 0, 0
    while (hyphen := _NDC_MIDDLE.search(xml, at)) is not None:
        at = hyphen.start() + 1
        starts = range(max(done, hyphen.start() - 5), hyphen.start() - 3)
        if (match := next(filter(None, (_NDC_ANYWHERE.match(xml, s) for s in starts)), None)) is not None:
            found.append(match[0])
            done = at = match.end()
    return found


def _chunks(body: ET.Element) -> list[str]:
    """Paragraphs, items and leaf content elements that are not inside a table."""
    found, stack = [], [(body, False)]
    while stack:
        element, inside = stack.pop()
        kind = _local(element)
        wanted = kind in ("paragraph", "item") or (kind == "content" and len(element) == 0)
        if wanted and not inside and (value := _flat(element)):
            found.append(value)
        inside = inside or kind == "table"
        stack.extend((child, inside) for child in reversed(element))
    return found


def _section(section: ET.Element) -> dict:
    body, code = section.find(_NS + "text"), section.find(_NS + "code")
    tables = [] if body is None else [t for t in body.iter() if _local(t) == "table"]
    blocks = [e for e in section.iter() if e.tag in (_NS + "paragraph", _NS + "item", _NS + "td")]
    return {
        "code": _attr(code, "code"),
        "code_name": _attr(code, "displayName"),
        "title": section.findtext(_NS + "title"),
        "has_text": body is not None,
        "raw_text": None if body is None else _flat(body),
        "chunks": [] if body is None else _chunks(body),
        "tables": [
            [
                [{"tag": _local(c), "value": _flat(c)} for c in row if _local(c) in ("th", "td")]
                for row in table.iter()
                if _local(row) == "tr"
            ]
            for table in tables
        ],
        "lines": [line for line in (" ".join("".join(e.itertext()).split()) for e in blocks) if line],
    }


def read_document(xml: str | None, parts: str = "all") -> dict | None:
    """Raw fields of one label document; None if it is not well-formed.

    ``parts``: ``records`` leaves section and document-wide ingredients out,
    ``details`` keeps them for documents without product subjects, ``all``
    keeps them always.
    """
    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError:
        return None
    code, title, below = root.find(_CODE), root.find(_TITLE), _below(root)
    subjects = _subjects(below)
    whole = parts == "all" or (parts == "details" and all(s["kind"] == "container" for s in subjects))
    return {
        "doc_code": _attr(code, "code"),
        "doc_type": _attr(code, "displayName"),
        "title": None if title is None else _flat(title),
        "author_org": _text(_first(below[_AUTHOR], _ENTITY, _ORG, _NAME)),
        "any_org": _text(_first(below[_ORG], _NAME)),
        "route": _attr(_first(below[_ROUTE]), "displayName"),
        "form": _attr(_first(below[_FORM]), "displayName"),
        "names": [_text(_first(below[p[0]], *p[1:], _NAME)) for p in _LAYOUTS],
        "forms": [_attr(_first(below[p[0]], *p[1:], _FORM), "displayName") for p in _LAYOUTS],
        "codes": [
            {"code": e.get("code"), "system": e.get("codeSystem")}
            for e in root.iter(_CODE)
            if _NDC_SHAPE.match(e.get("code", ""))
        ],
        "text_ndcs": list(dict.fromkeys(_ndcs_anywhere(xml))),
        "subjects": subjects,
        "ingredients": _ingredients(root) if whole else [],
        "sections": [_section(s) for s in root.iter(_NS + "section")] if whole else [],
    }


def _parse(batch: pa.Array, parts: str) -> pa.Array:
    # documents hold no cycles: the collector would only walk a batch's elements again and again
    collecting = gc.isenabled()
    gc.disable()
    try:
        made = _document_type()
        read = [pa.array([read_document(x, parts) for x in some.to_pylist()], type=made) for some in _slices(batch)]
        return pa.concat_arrays(read) if read else pa.array([], type=made)
    finally:
        if collecting:
            gc.enable()


def parse_label(xml: Column | str, parts: str = "all") -> Column:
    """The document struct of an XML text column."""

    def parse(batch: pa.Array) -> pa.Array:
        return _parse(batch, parts)

    # declared non-deterministic so that filters on the result are not pushed
    # through it, which would parse every document once more
    return F.arrow_udf(parse, schemas.DOCUMENT).asNondeterministic()(xml)


def parse_archives(listed: DataFrame, parts: str = "all") -> DataFrame:
    """``parse_documents`` of ``read_archives``: the XML is parsed by the task that unpacks it and does not leave it."""
    return archives.read_archives(listed, read_xml=("doc", DataType.fromDDL(schemas.DOCUMENT), lambda xml: _parse(xml, parts)))


def _slices(batch: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """The batch in pieces of that many bytes, or of one document: fields weigh several times their XML as Python objects."""
    start = held = 0
    for n, size in enumerate(pc.binary_length(batch).to_pylist()):
        if n > start and held + (size or 0) > most:
            yield batch.slice(start, n - start)
            start, held = n, 0
        held += size or 0
    if start < len(batch):
        yield batch.slice(start)


def _document_type() -> pa.DataType:
    code = pa.struct([("code", pa.string()), ("system", pa.string())])
    strings = pa.list_(pa.string())
    ingredient = pa.struct(
        [("class_code", pa.string()), ("legacy_role", pa.string()), ("direct", pa.bool_()), ("name", pa.string()),
         ("has_substance", pa.bool_()), ("codes", pa.list_(code)), ("num_value", pa.string()), ("num_unit", pa.string()),
         ("den_value", pa.string()), ("den_unit", pa.string())]
    )
    subject = pa.struct(
        [("container", pa.int32()), ("kind", pa.string()), ("nth", pa.int32()), ("name", pa.string()), ("form", pa.string()),
         ("route", pa.string()), ("container_route", pa.string()), ("ndc_codes", strings), ("ingredients", pa.list_(ingredient))]
    )
    cell = pa.struct([("tag", pa.string()), ("value", pa.string())])
    section = pa.struct(
        [("code", pa.string()), ("code_name", pa.string()), ("title", pa.string()), ("has_text", pa.bool_()),
         ("raw_text", pa.string()), ("chunks", strings), ("tables", pa.list_(pa.list_(pa.list_(cell)))), ("lines", strings)]
    )
    return pa.struct(
        [("doc_code", pa.string()), ("doc_type", pa.string()), ("title", pa.string()), ("author_org", pa.string()),
         ("any_org", pa.string()), ("route", pa.string()), ("form", pa.string()), ("names", strings), ("forms", strings),
         ("codes", pa.list_(code)), ("text_ndcs", strings), ("subjects", pa.list_(subject)),
         ("ingredients", pa.list_(ingredient)), ("sections", pa.list_(section))]
    )


def parse_documents(members: DataFrame, parts: str = "all") -> DataFrame:
    """Replace the ``xml`` column by the parsed ``doc`` (NULL if unreadable)."""
    # documents differ in length by orders of magnitude: batches are bounded by bytes, whatever rows they may have
    members.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return members.withColumn("doc", parse_label("xml", parts)).drop("xml")


# --- pipeline flavour ---------------------------------------------------------------


def pipeline_strength(i: Column) -> Column:
    """``10 g/15 mL``; a denominator value of 1 is left out, a unitless one dropped."""
    value, unit = [text.strip(F.coalesce(i[c], F.lit(""))) for c in ("num_value", "num_unit")]
    den_value, den_unit = [text.strip(F.coalesce(i[c], F.lit(""))) for c in ("den_value", "den_unit")]
    amount = F.concat(value, F.lit(" "), unit)
    no_denominator = (den_value == "") | den_unit.isin("", "1")
    return F.when(
        (value != "") & ~unit.isin("", "1"),
        F.when(no_denominator, amount)
        .when(den_value == "1", F.concat(amount, F.lit("/"), den_unit))
        .otherwise(F.concat(amount, F.lit("/"), den_value, F.lit(" "), den_unit)),
    )


def pipeline_unii(i: Column) -> Column:
    codes = F.filter(
        i["codes"], lambda c: (c["system"] == vocab.UNII_CODE_SYSTEM) & (text.strip(F.coalesce(c["code"], F.lit(""))) != "")
    )
    return text.strip(F.get(codes, F.lit(0))["code"])


def _named(items: Column, codes: list[str]) -> Column:
    """Direct ingredients of the given classes that carry a name."""
    return F.filter(
        items,
        lambda i: i["direct"]
        & F.coalesce(i["class_code"].isin(codes), F.lit(False))
        & (text.strip(F.coalesce(i["name"], F.lit(""))) != ""),
    )


def product_records(parsed: DataFrame) -> DataFrame:
    """One record per product subject, in document order."""
    doc = F.col("doc")
    wanted = F.filter(
        doc["subjects"],
        lambda s: ((s["kind"] == "manufacturedProduct") & (s["nth"] == 0)) | (s["kind"] == "container"),
    )
    keep = [c for c in parsed.columns if c != "doc"]
    rows = parsed.select(
        *keep,
        doc["doc_type"].alias("_type"),
        F.coalesce(text.blank_to_null(doc["author_org"]), text.blank_to_null(doc["any_org"])).alias("_org"),
        F.array_distinct(
            F.transform(F.filter(doc["codes"], lambda c: c["system"] == vocab.NDC_CODE_SYSTEM), lambda c: c["code"])
        ).alias("ndcs"),
        F.posexplode(wanted).alias("subject_seq", "s"),
    )

    def present(c: Column) -> Column:
        return text.blank_to_null(text.strip(c))

    actives = F.transform(
        _named(F.col("s.ingredients"), vocab.ACTIVE_CLASS_CODES),
        lambda i: F.struct(
            text.strip(i["name"]).alias("name"), pipeline_strength(i).alias("strength"), pipeline_unii(i).alias("unii")
        ),
    )
    inactives = F.transform(
        _named(F.col("s.ingredients"), vocab.INACTIVE_CLASS_CODES),
        lambda i: F.struct(
            text.strip(i["name"]).alias("raw_name"),
            text.normalize_simple(i["name"]).alias("normalized_name"),
            pipeline_unii(i).alias("unii"),
        ),
    )
    return rows.select(
        *keep,
        "subject_seq",
        F.coalesce(present(F.col("s.name")), F.lit("Unknown")).alias("product_name"),
        text.strip(F.col("_org")).alias("labeler"),
        present(F.col("s.form")).alias("dosage_form"),
        F.coalesce(text.blank_to_null(F.col("s.route")), text.blank_to_null(F.col("s.container_route"))).alias("route"),
        text.blank_to_null(F.col("_type")).alias("product_type"),
        "ndcs",
        actives.cast(f"array<{schemas.ACTIVE}>").alias("actives"),
        inactives.cast(f"array<{schemas.INACTIVE}>").alias("inactives"),
    )


def labels_read(parsed: DataFrame) -> DataFrame:
    """One row per label with ``parsed``: it is well-formed and has product subjects."""
    return parsed.select("source_file", "member", "setid", _has_subjects().alias("parsed"))


def _has_subjects() -> Column:
    return F.coalesce(F.size("doc.subjects") > 0, F.lit(False))


def first_labels_read(parsed: DataFrame) -> DataFrame:
    """``labels_read`` of ``first_label_per_archive``; of the documents only that one mark is shuffled."""
    columns = ["source_file", "member", "setid", "member_seq", "xml_seq"]
    marked = first_label_per_archive(parsed.select(*columns, _has_subjects().alias("parsed")))
    return marked.select("source_file", "member", "setid", "parsed")


def parse_failures(parsed: DataFrame) -> DataFrame:
    return unread_labels(labels_read(parsed))


def unread_labels(labels: DataFrame) -> DataFrame:
    """The failures among the rows of ``labels_read``."""
    return labels.filter(~F.col("parsed")).select(
        "source_file",
        F.col("member").alias("xml_member_name"),
        F.lit("parse_error").alias("error_type"),
        F.lit("no product subjects").alias("error_message"),
    )


def first_label_per_archive(parsed: DataFrame) -> DataFrame:
    """Within one archive the first label of a setid counts.

    Runs on parsed rows: the duplicates are rare, and the XML text itself is
    never shuffled.
    """
    return first_per_key(parsed, ["source_file", "setid"], [F.col("member_seq"), F.col("xml_seq")])


# --- app flavour ----------------------------------------------------------------------


def app_strength(i: Column) -> Column:
    """``100 mg/1 mL``; parts without unit show the bare value, a bare 1 below is dropped."""

    def part(value: Column, unit: Column) -> Column:
        clean = F.struct(
            text.squash(F.coalesce(value, F.lit(""))).alias("v"), text.squash(F.coalesce(unit, F.lit(""))).alias("u")
        )
        shown = lambda x: F.when(x["u"].isin("", "1"), x["v"]).otherwise(F.concat(x["v"], F.lit(" "), x["u"]))
        return text.bind(clean, lambda x: F.when(x["v"] != "", shown(x)))

    both = F.struct(part(i["num_value"], i["num_unit"]).alias("top"), part(i["den_value"], i["den_unit"]).alias("bottom"))
    return text.bind(
        both,
        lambda b: F.when(b["bottom"] != "1", F.concat(b["top"], F.lit("/"), b["bottom"])).otherwise(b["top"]),
    )


def product_data_entries(items: Column, role: str) -> Column:
    """Ingredient entries of structured nodes, modern layout first, then legacy."""
    codes = vocab.APP_ACTIVE_CLASS_CODES if role == "active" else vocab.INACTIVE_CLASS_CODES
    modern = F.filter(
        items, lambda i: i["legacy_role"].isNull() & F.upper(text.squash(F.coalesce(i["class_code"], F.lit("")))).isin(codes)
    )
    legacy = F.filter(items, lambda i: i["legacy_role"] == role)
    nodes = F.filter(F.concat(modern, legacy), lambda i: text.squash(F.coalesce(i["name"], F.lit(""))) != "")

    def entry(i: Column) -> Column:
        name = text.squash(i["name"])
        return ingredients.build_entry(
            name, "xml_structured", role, unii=text.squash(F.get(i["codes"], F.lit(0))["code"]), strength=app_strength(i), raw_name=name
        )

    return ingredients.distinct_entries(F.transform(nodes, entry), ignore_case=True)


def _header(c: Column) -> Column:
    return text.strip_chars(text.squash(F.lower(c)), " :")


def _is_name_header(h: Column) -> Column:
    return h.isin(vocab.INGREDIENT_HEADERS)


def _is_strength_header(h: Column) -> Column:
    return F.contains(h, F.lit("strength")) | h.isin(vocab.STRENGTH_HEADERS)


def _unii_cell(c: Column) -> Column:
    def body(upper: Column) -> Column:
        found = text.blank_to_null(F.regexp_extract(upper, "[A-Z0-9]{10}", 0))
        return F.coalesce(found, text.blank_to_null(upper))

    return text.bind(F.upper(text.squash(c)), body)


def _cell_role(header: Column) -> Column:
    """What a column holds by its header; a name header wins over UNII, UNII over strength."""
    return (
        F.when(_is_name_header(header), "name")
        .when(F.contains(header, F.lit("unii")), "unii")
        .when(_is_strength_header(header), "strength")
    )


def _table_row_entry(values: Column, headers: Column, role: str) -> Column:
    """Entry of one data row: by header where headers are known, else columns 1, 2, 3."""
    by_place = F.array(F.lit("name"), F.lit("strength"), F.lit("unii"))
    roles = F.coalesce(F.transform(headers, _cell_role), by_place)
    cells = F.transform(values, lambda v, i: F.struct(v.alias("v"), F.get(roles, i).alias("role")))

    def entry(cs: Column) -> Column:
        def last(wanted: str) -> Column:
            # the last column of a kind counts
            return F.get(F.reverse(F.filter(cs, lambda c: c["role"] == wanted)), F.lit(0))["v"]

        return ingredients.build_entry(
            F.coalesce(last("name"), F.get(values, F.lit(0))),
            "table",
            role,
            unii=_unii_cell(last("unii")),
            strength=last("strength"),
            raw_name=F.array_join(values, " | "),
        )

    return text.bind(cells, entry)


def table_entries(tables: Column, role: str) -> Column:
    """Ingredient entries of all tables of a section body."""

    def one(table: Column) -> Column:
        rows = F.transform(
            table,
            lambda r: F.struct(
                F.exists(r, lambda c: c["tag"] == "th").alias("th"),
                F.filter(F.transform(r, lambda c: c["value"]), lambda v: v != "").alias("vals"),
            ),
        )
        return text.bind(F.filter(rows, lambda r: F.size(r["vals"]) > 0), entries)

    def heads(r: Column) -> Column:
        names = F.transform(r["vals"], _header)
        return r["th"] | F.exists(
            names, lambda h: _is_name_header(h) | _is_strength_header(h) | F.contains(h, F.lit("unii"))
        )

    def entries(rows: Column) -> Column:
        return text.bind(F.array_position(F.transform(rows, heads), True), lambda at: shaped(rows, at))

    def shaped(rows: Column, at: Column) -> Column:
        # rows above the header row have no headers; the header row itself gives no entry
        headers = F.transform(F.get(rows, (at - 1).cast("int"))["vals"], _header)
        none = F.lit(None).cast("array<string>")

        def entry(r: Column, i: Column) -> Column:
            known = F.when((at > 0) & (i + 1 > at), headers).otherwise(none)
            return F.when(i + 1 != at, text.bind(known, lambda h: _table_row_entry(r["vals"], h, role)))

        return F.transform(rows, entry)

    return ingredients.distinct_entries(F.flatten(F.transform(tables, one)), ignore_case=True)


def structured_chunks(section: Column) -> Column:
    """Text of paragraphs and items outside tables, distinct ignoring case."""
    return text.keep_first_by(section["chunks"], F.lower, F.array().cast("array<string>"))


def _mentions(section: Column, terms: list[str]) -> Column:
    pattern = r"(?U)(?:^|\b)(?:" + "|".join(terms) + r")(?:$|\b)"

    def hit(c: Column) -> Column:
        return F.rlike(F.lower(text.squash(F.coalesce(c, F.lit("")))), F.lit(pattern))

    return hit(section["title"]) | hit(section["code_name"])


def matching_section(doc: Column, terms: list[str]) -> Column:
    """First section with a text body whose title or code name mentions a term."""
    return F.get(F.filter(doc["sections"], lambda s: s["has_text"] & _mentions(s, terms)), F.lit(0))


def section_text(doc: Column, terms: list[str]) -> Column:
    hits = F.filter(doc["sections"], lambda s: s["has_text"] & _mentions(s, terms) & (s["raw_text"] != ""))
    return F.get(hits, F.lit(0))["raw_text"]


def section_entries(doc: Column, role: str) -> Column:
    """Cascade: table rows, else structured chunks, else product data, else narrative.

    Without a matching section only product data counts.
    """
    terms = vocab.INACTIVE_SECTION_TERMS if role == "inactive" else vocab.ACTIVE_SECTION_TERMS

    def cascade(s: Column) -> Column:
        data = product_data_entries(doc["ingredients"], role)
        tables = table_entries(s["tables"], role)
        chunks = ingredients.parse_structured(structured_chunks(s), role)
        narrative = ingredients.parse_narrative(s["raw_text"], role)
        return F.when(s.isNull(), data).otherwise(_first_filled(tables, chunks, data, narrative))

    return text.bind(matching_section(doc, terms), cascade)


def _first_filled(*candidates: Column) -> Column:
    chosen = candidates[-1]
    for c in reversed(candidates[:-1]):
        chosen = F.coalesce(text.bind(c, lambda a: F.when(F.size(a) > 0, a)), chosen)
    return chosen


def app_labeler(doc: Column) -> Column:
    return F.coalesce(
        text.blank_to_null(text.squash(doc["any_org"])), text.blank_to_null(text.squash(doc["author_org"]))
    )


def _first_present(values: Column) -> Column:
    cleaned = F.filter(F.transform(values, lambda v: text.squash(F.coalesce(v, F.lit("")))), lambda v: v != "")
    return F.get(cleaned, F.lit(0))


def _with_suffix(name: Column, suffix: Column) -> Column:
    """Append unless missing or already contained, ignoring case."""
    extend = (F.coalesce(suffix, F.lit("")) != "") & ~F.contains(F.lower(name), F.lower(suffix))
    return F.when(extend, F.concat(name, F.lit(" "), suffix)).otherwise(name)


def _single_detail(doc: Column) -> Column:
    given = _first_present(doc["names"])
    name = F.coalesce(
        _with_suffix(given, _first_present(doc["forms"])), text.blank_to_null(doc["title"]), F.lit("Unknown product")
    )
    return F.struct(
        name.alias("product_name"),
        doc["text_ndcs"].alias("ndcs"),
        text.squash(doc["route"]).alias("route"),
        text.squash(doc["form"]).alias("dosage_form"),
        app_labeler(doc).alias("labeler"),
        doc["doc_type"].alias("product_type"),
        section_entries(doc, "active").alias("active_ingredients"),
        section_entries(doc, "inactive").alias("inactive_ingredients"),
        matching_section(doc, vocab.INACTIVE_SECTION_TERMS)["raw_text"].alias("inactive_ingredients_raw"),
    )


def _subject_detail(doc: Column, s: Column) -> Column:
    form = text.blank_to_null(text.squash(s["form"]))
    plain_name = F.coalesce(text.blank_to_null(text.squash(s["name"])), F.lit("Unknown product"))

    def fields(active: Column, inactive: Column) -> Column:
        name = text.bind(plain_name, lambda n: _with_suffix(n, F.get(active, F.lit(0))["strength"]))
        return F.struct(
            text.bind(name, lambda n: _with_suffix(n, form)).alias("product_name"),
            F.array_distinct(s["ndc_codes"]).alias("ndcs"),
            F.coalesce(text.blank_to_null(text.squash(s["route"])), text.squash(doc["route"])).alias("route"),
            form.alias("dosage_form"),
            app_labeler(doc).alias("labeler"),
            F.lit(None).cast("string").alias("product_type"),
            active.alias("active_ingredients"),
            inactive.alias("inactive_ingredients"),
            text.blank_to_null(F.array_join(F.transform(inactive, lambda e: e["display_name"]), ", ")).alias(
                "inactive_ingredients_raw"
            ),
        )

    return text.bind(
        product_data_entries(s["ingredients"], "active"),
        lambda a: text.bind(product_data_entries(s["ingredients"], "inactive"), lambda i: fields(a, i)),
    )


def _unpack(parsed: DataFrame, details: Column) -> DataFrame:
    keep = [c for c in parsed.columns if c != "doc"]
    rows = parsed.filter("doc IS NOT NULL").select(*keep, F.posexplode(details).alias("subject_seq", "d"))
    return rows.select(*keep, "subject_seq", "d.*")


def single_details(parsed: DataFrame) -> DataFrame:
    """One detail per document: names from four layouts, else the title."""
    return _unpack(parsed, F.array(_single_detail(F.col("doc"))))


def all_details(parsed: DataFrame) -> DataFrame:
    """One detail per product subject; documents without subjects give one detail.

    Subject details carry no product type, so the human filter lets them pass.
    """
    return _unpack(parsed, _details(parsed.sparkSession.sparkContext))


def _details(context: SparkContext) -> Column:
    """The details of ``doc``; building the expression takes seconds, so a Spark context builds it once and keeps it."""
    if not hasattr(context, "_labelmill_details"):
        doc = F.col("doc")
        products = F.filter(doc["subjects"], lambda s: s["kind"] != "container")
        context._labelmill_details = text.bind(
            products,
            lambda ps: F.when(F.size(ps) > 0, F.transform(ps, lambda s: _subject_detail(doc, s))).otherwise(
                F.array(_single_detail(doc))
            ),
        )
    return context._labelmill_details


def details_as_records(details: DataFrame) -> DataFrame:
    """Details in the shape of product records, for tiering and comparison."""
    actives = F.transform(
        "active_ingredients",
        lambda e: F.struct(e["normalized_name"].alias("name"), e["strength"].alias("strength"), e["unii"].alias("unii")),
    )
    inactives = F.transform(
        "inactive_ingredients",
        lambda e: F.struct(
            e["display_name"].alias("raw_name"), e["normalized_name"].alias("normalized_name"), e["unii"].alias("unii")
        ),
    )
    return details.withColumns({"actives": actives, "inactives": inactives}).drop(
        "active_ingredients", "inactive_ingredients"
    )
