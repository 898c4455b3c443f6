"""The pipeline's stages at the smallest size against brute force, and the registered queries' SQL."""
from collections import Counter


import __spark_entry__ as ent
import corpus_pipeline
from oracle_check import compare, duck
from test_operators import components_of

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(docs.toPandas())
    clean, distinct, apart, mixed, pieces = kept
    assert sorted(distinct["doc_id"]) == sorted(clean.groupby("text")["doc_id"].min())
    rows = [(int(i), t) for i, t in zip(distinct["doc_id"], distinct["text"])]
    assert sorted(apart["doc_id"]) == sorted(i for i, _, c in components_of(rows, 5, 80) if c == i)
    assert set(mixed["doc_id"]) <= set(apart["doc_id"]) and len(mixed)
    assert Counter(pieces.groupby("doc_id")["length"].sum()) == Counter(pieces.groupby("doc_id")["doc_tokens"].first())
    assert (pieces.groupby("sequence_id")["length"].sum().sort_index().to_numpy()[:-1] == 1024).all()


def test_queries_with_sql(spark):
    con = duck(SF)
    for name in ("op3_exact_dedup",):
        line = compare(spark, con, SF, name, ent.queries()[name], ent.oracle_sql()[name])
        assert "MISMATCH" not in line, line
    assert {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in ent.queries()} and "pipeline" in ent.queries()
