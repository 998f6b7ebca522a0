"""Each stage against a plain reading of its rule; the packed ids against what the stages kept."""

import numpy as np
import pytest

import corpus_pipeline
from atrium.llm import registry, secrets

from tests.llm.test_near_dup import brute

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        where = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, FOLDER).write.parquet(where)
        docs = spark.read.parquet(where)
        out.append(docs)
    return out


def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def test_order_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_classifier", "minhash_near_dedup", "secret_scans", "packing"]
    for docs in steps[1:-1]:
        assert docs.columns == steps[0].columns and [f.dataType for f in docs.schema] == [f.dataType for f in steps[0].schema]


def test_filters_keep_clean_documents(spark, steps):
    good = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/labels.parquet").where("quality = 1").collect()}
    first, second, third = (set(texts(s)) for s in steps[:3])
    assert second <= first and len(second) > 0.97 * len(first)
    assert third <= second and len(good & third) > 0.98 * len(good & second)


def test_one_of_each_group_stays(steps):
    before, after = texts(steps[2]), texts(steps[3])
    want = {i for i, (_, c) in brute(list(before.items()), 5).items() if i == c}
    assert set(after) == want and all(before[i] == t for i, t in after.items())


def test_secrets_are_gone(steps):
    before, after = texts(steps[3]), texts(steps[4])
    for i, t in before.items():
        assert after[i] == secrets.redact(t, secrets.find_spans(t))
    assert before != after


def test_packed_ids_are_the_documents(spark, steps):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(registry.vocabulary_file("byte_bpe_50k.json"))
    want = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in texts(steps[4]).items()}
    got = {}
    for r in sorted(steps[5].collect(), key=lambda r: (r.doc_id, r.start)):
        part = got.setdefault(r.doc_id, [])
        assert r.start == len(part)
        part += np.frombuffer(r.ids, "<u4").tolist()
    assert got == want


def test_odd_documents_pass_through_all_stages(spark, odd, empty):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(r.doc_id, r.text, r.lang if r.doc_id != 9 else None, None, None) for r in odd.collect()]
    for docs in (spark.createDataFrame(rows, kind), spark.createDataFrame([], kind)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, FOLDER)
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs.count()
        assert corpus_pipeline.pack(spark, docs, FOLDER).count() >= 0


def test_stages_pass_on_columns_of_any_name(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(300).selectExpr("*", "1 as score", "2 as kept", "3 as doc", "4 as `a.b`", "5 as lang_pred", "6 as _h")
    docs = documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == documents.columns
    row = docs.first()
    assert row is not None and tuple(row)[-6:] == (1, 2, 3, 4, 5, 6)
