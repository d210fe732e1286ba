"""The pipeline's stages: their order, columns and decisions; and the registered queries' columns."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from canopygrid.llm import secrets, tokens
from canopygrid.llm.tables import stored
from compare import connect, differences
from test_nearcopies import shingled, similarity

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op2": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op3": "doc_id tokens p_en p_fr p_de p_es rate copies",
    "op4": "doc_id piece start length ids_crc32 sequence_id offset",
    "op5": "doc_id fingerprint component_id",
    "op6": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op7": "query_id rank vec_id score",
    "op8": "doc_id held_out score predicted",
    "op9": "doc_id start n_tokens ids_crc32",
    "op10": "doc_id held_out lang_pred score",
    "op11": "lang rank phrase a l r n score",
    "op12": "vec_id n_links component_id kept",
    "op13": "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256",
}


def firsts(sets):
    """The smallest id of every group of sets linked at a similarity of 0.8, by all pairs."""
    least = {i: i for i in sets}
    linked = [(i, j) for i in sets for j in sets if i < j and similarity(sets[i], sets[j]) >= 0.8]
    while any(least[i] != least[j] for i, j in linked):
        for i, j in linked:
            least[i] = least[j] = min(least[i], least[j])
    return {i for i in sets if least[i] == i}


@pytest.mark.parametrize("op", COLUMNS)
def test_columns_and_rows(spark, op):
    (name,) = [q for q in entry.queries() if q.startswith(f"{op}_")]
    got = entry.queries()[name](spark, SF)
    assert got.columns == COLUMNS[op].split()
    source = spark.read.parquet(f"{SF}/{'embeddings' if op == 'op12' else 'documents'}.parquet")
    if op not in ("op4", "op7", "op11"):
        assert got.count() == source.count()
    if name in entry.oracle_sql():
        assert differences(got, connect(SF), entry.oracle_sql()[name]) == []


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before = {r.doc_id: r for r in docs.collect()}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), "test-stage")
        assert docs.columns == columns
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before) and docs.count() == len(after)
        if name == "quality classifier":
            seen = [labels[i] == (i in after) for i in before if i in labels]
            assert sum(seen) / len(seen) > 0.9
        if name == "simhash near-dedup":
            assert set(after) == firsts({i: shingled(r.text) for i, r in before.items()})
        if name == "secret scans":
            assert set(after) == set(before)
            assert secrets.report(docs).filter("spans <> ''").count() == 0
            for i, r in after.items():
                assert r.n_chars == len(r.text)
                assert (r.text == before[i].text) == (secrets.COVER not in r.text)
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    tokenizer = Tokenizer.from_file(tokens.vocabulary_path())
    for i, r in before.items():
        ids = np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 0], "<u4")
        own = sorted((p.start, p.length, p.ids_crc32) for p in pieces if p.doc_id == i)
        assert sum(n for _, n, _ in own) == len(ids)
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == crc for a, n, crc in own)


def test_run_and_awkward_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (9001, "", "en", "s", 0), (9001, "", "en", "s", 0), (9002, "w " * 20_000, "xx", "s", 1)],
        docs.schema,
    )
    docs.union(odd).withColumns({"score": F.lit(1), "kept": F.lit("x"), "fp": F.lit(2)}).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == COLUMNS["op4"].split()
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
