import corpus_pipeline as C
from medialoom.llm import queries


def test_names():
    found = sorted(queries.queries(), key=lambda q: int(q[2:].split("_")[0]))
    assert [int(q[2:].split("_")[0]) for q in found] == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(found)


def test_stages_against_brute_force(spark, docs, rows, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    text = next(t for i, t, *_ in rows if i == 20)
    spark.createDataFrame([(1, " ".join(text.split()[:14]))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, counts = docs, []
    for name, stage in C.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != C.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(now.count())
    assert counts == sorted(counts, reverse=True)
    ids = {r.doc_id for r in now.collect()}
    assert 20 not in ids and not ids & {200, 201, 300, 301, 302, 303} and {7, 8, 30} <= ids
    assert now.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    whole = C.run(spark, str(tmp_path)).collect()
    assert {tuple(r) for r in whole} == {tuple(r) for r in now.collect()}
