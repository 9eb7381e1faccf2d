import hashlib

import public_tokenizers
import sentencepiece

import __spark_entry__ as entry_points
import corpus_pipeline as C
from behavior_spark.llm import mixing, quality_rules
from behavior_spark.llm.common import written
from tests.llm.helpers import frame
from tests.llm.test_lines import left
from tests.llm.test_lines import slow as slow_lines
from tests.llm.test_simhash import slow_classes

FOLDER = "/root/testdata/sf0.001"


def test_each_stage_equals_plain_loops(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    by_name = dict(C.STAGES)

    def stage(name, docs):
        out = written(by_name[name](spark, docs, FOLDER), "test")
        return out, {r.doc_id: r for r in out.collect()}

    first, rows = stage("quality rules", docs)
    cascade = quality_rules.Cascade(quality_rules.RULES, tuple(range(len(quality_rules.RULES))))
    assert set(rows) == {r.doc_id for r in docs.collect() if cascade.failed(quality_rules.Text(r.text.encode())) is None}
    second, edited = stage("line dedup", first)
    given = sorted((i, r.text) for i, r in rows.items())
    assert {i: r.text for i, r in edited.items()} == {i: left(t, g) for (i, t), g in zip(given, slow_lines(given))}
    third, single = stage("SimHash near-dedup", second)
    assert set(single) == {c for _, _, c in slow_classes(sorted((i, r.text) for i, r in edited.items()))}
    fourth, _ = stage("mixing", third)
    assert [f.columns for f in (first, second, third, fourth)] == [columns] * 4
    passes = mixing.pieces(mixing.taken(third)).where("words * 2 >= size").groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in fourth.groupBy("doc_id").count().collect()} == {r.doc_id: r["count"] for r in passes}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((r.doc_id, hashlib.sha256(",".join(map(str, library.encode(r.text))).encode()).hexdigest()) for r in fourth.collect())
    assert sorted((r.doc_id, r.ids_sha256) for r in C.run(spark, FOLDER).collect()) == want


def test_stages_take_awkward_and_empty_tables(spark):
    for rows in (None, []):
        docs = frame(spark, rows)
        for _, stage in C.STAGES:
            docs = written(stage(spark, docs, FOLDER), "test")
        assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_every_operator_has_its_query():
    names = entry_points.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10
    assert "pipeline" in names
    assert set(entry_points.oracle_sql()) <= set(names)
