import hashlib

from pyspark.sql import functions as F

import corpus_pipeline
from wrenchlake.llm import bpe, near_dedup, quality_gam
from wrenchlake.llm.queries import ORACLE, QUERIES


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, small).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0.5 * seen[0]
    first = spark.read.parquet(f"{tmp_path}/quality")
    model = quality_gam.fit(spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet"))
    good = [r.doc_id for r in spark.read.parquet(f"{small}/documents.parquet").collect() if model.score(quality_gam.features([r.text.encode()]))[0] >= 0.7]
    assert sorted(r.doc_id for r in first.collect()) == sorted(good)
    second = spark.read.parquet(f"{tmp_path}/near_duplicates")
    assert near_dedup.near_duplicates(second, 80).where("NOT kept").count() == 0
    b = bpe.Bpe(bpe.default_vocabulary())
    cleaned = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/benchmark_leaks").collect()}
    for r in docs.limit(20).collect():
        ids = b.encode(cleaned[r.doc_id].encode())
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(" ".join(b.token[i] for i in ids).encode()).hexdigest()


def test_stages_on_odd_rows(spark, small, tmp_path):
    """Null, empty, very long and repeated rows, one id with two texts, other columns, and no rows at all."""
    documents = spark.read.parquet(f"{small}/documents.parquet")
    good = [r.text for r in documents.where("length(text) BETWEEN 2000 AND 4000").orderBy("doc_id").select("text").limit(3).collect()]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "word " * 40000), (5, good[0]), (5, good[0]), (5, good[1]), (6, good[0]), (None, good[2]), (None, None), (7, good[2] + " tail")]
    odd = spark.createDataFrame(rows, "doc_id long, text string")
    fill = {f.name: F.lit(None).cast(f.dataType) for f in documents.schema if f.name not in odd.columns}
    odd = odd.withColumns(fill).select(documents.columns).withColumns({c: F.lit(c) for c in ("k", "k1", "keep", "new_text", "n_tokens_", "score")})
    for name, df in (("odd", odd), ("none", odd.limit(0))):
        docs = df
        for stage, run in corpus_pipeline.STAGES:
            before = docs.count()
            run(spark, docs, small).write.parquet(f"{tmp_path}/{name}/{stage}")
            docs = spark.read.parquet(f"{tmp_path}/{name}/{stage}")
            assert docs.count() <= before
            if stage != "tokens":
                assert docs.columns == df.columns
        assert docs.count() == 0 if name == "none" else docs.count() >= 1
    direct = near_dedup.drop_near_duplicates(odd, 80)
    kept = sorted(((r.doc_id, r.text) for r in direct.collect()), key=str)
    assert kept == sorted([(1, None), (2, ""), (3, " \n"), (4, rows[3][1]), (5, good[0]), (5, good[1]), (7, rows[10][1]), (None, good[2]), (None, None)], key=str)


def test_run_equals_the_stages(spark, small):
    assert corpus_pipeline.run(spark, small).select("doc_id").count() > 0


def test_ten_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLE) <= set(QUERIES)
