"""Every stage against a plain version of what it decides, each on what the stage before kept."""

from collections import Counter

import pytest

import corpus_pipeline as cp
from labelmill.llm import byte_cnn, golay_simhash, mil_quality, poisson_mix
from labelmill.llm.common import keep
from tests.llm.test_bpe import expected_codes
from tests.llm.test_mix import plain_count
from tests.llm.test_near_sets import plain_kept

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows before and after every stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        after = keep(stage(spark, docs, SF), "test-stage")
        out[name] = (docs, after)
        docs = after
    return out


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages_are_the_dealt_ones():
    assert [name for name, _ in cp.STAGES] == ["quality", "language", "near_duplicates", "mixing", "encoding"]


def test_columns_stay_until_the_last_stage(stages):
    for name in ("quality", "language", "near_duplicates", "mixing"):
        before, after = stages[name]
        assert after.dtypes == before.dtypes


def test_rejected_documents_go(spark, stages):
    before, after = stages["quality"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = mil_quality.fit(before, labels)
    assert rows(after) == Counter(tuple(r) for r in before.collect() if model.scores([r["text"]])[0] >= 0.5)
    marks = {r["doc_id"]: r["quality"] for r in labels.collect()}
    stayed = {r["doc_id"] for r in after.collect()}
    good = [i for i, q in marks.items() if q == 1]
    assert sum(i in stayed for i in good) >= 0.95 * len(good)
    assert sum(marks.get(i) == 0 for i in stayed) <= 2


def test_uncertain_languages_go(spark, stages):
    before, after = stages["language"]
    net = byte_cnn.fit(before)
    kept = Counter()
    for r in before.collect():
        found = net.classify([r["text"]])
        if found["lang_pred"][0] != "und" and found["score"][0] >= cp.LEAST_CERTAIN:
            kept[tuple({**r.asDict(), "lang": r["lang"] or found["lang_pred"][0]}.values())] += 1
    assert rows(after) == kept


def test_one_document_of_a_group_stays(stages):
    before, after = stages["near_duplicates"]
    docs = before.collect()
    ids = set(plain_kept([(r["doc_id"], r["text"]) for r in docs]))
    assert rows(after) == Counter(tuple(r) for r in docs if r["doc_id"] in ids)


def test_copies_are_the_drawn_ones(stages):
    before, after = stages["mixing"]
    rate = {r["source"]: r["rate"] for r in poisson_mix.rates(before).collect()}
    expected = Counter()
    for r in before.collect():
        if n := plain_count(cp.MIX_SEED, r["doc_id"], rate[r["source"] or ""]):
            expected[tuple(r)] += n
    assert rows(after) == expected


def test_ids_are_the_librarys(stages):
    before, after = stages["encoding"]
    texts = Counter((r["doc_id"], *e) for r, e in zip(before.collect(), expected_codes(r["text"] for r in before.collect())))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in after.collect()) == texts


def test_odd_rows_pass_all_stages(spark, odd_docs):
    docs = odd_docs
    for _, stage in cp.STAGES:
        docs = keep(stage(spark, docs, SF), "test-stage")
    assert docs.count() >= 0
    assert golay_simhash.one_of_each(odd_docs.limit(0)).count() == 0


def test_registered_run(spark, stages):
    assert cp.run(spark, SF).count() == stages["encoding"][1].count()
