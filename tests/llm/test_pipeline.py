"""The pipeline's stages on whole small tables, each held against its operator's rule."""

import corpus_pipeline as C
from postlens.llm import common, queries

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = common.table(spark, SF, "documents")
    columns, out = docs.columns, common.run_dir(spark, "tp")
    ids = [{r.doc_id for r in docs.collect()}]
    for k, (name, stage) in enumerate(C.STAGES):
        stage(spark, docs, SF).write.parquet(f"{out}/{k}")
        docs = spark.read.parquet(f"{out}/{k}")
        if k < 3:
            assert docs.columns == columns
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert ids[0] > ids[1] > ids[2] >= ids[3] == ids[4]
    kept = queries.QUERIES["op5_quality_rules"](spark, SF)
    assert ids[3]
    assert {r.doc_id for r in kept.where("base_failed").collect()} & ids[2] == set()


def test_run_gives_the_last_stage(spark):
    got = C.run(spark, SF)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(got.columns) and got.count() > 0
    assert [n for n, _ in C.STAGES] == ["toxicity", "quality", "near_duplicates", "packing"] and C.ORACLE_SQL is None


def test_empty_documents(spark):
    docs = common.table(spark, SF, "documents").limit(0)
    for name, stage in C.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.collect() == []


def test_every_query_is_there():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_odd_rows_and_clashing_columns(spark):
    """Null ids and texts, repeats, long texts and columns named like the stages' own."""
    good = " ".join(f"plain{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)) + "."
    other = " ".join(f"other{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)) + "."
    rows = [(1, good), (2, good + " more."), (3, None), (4, ""), (None, good), (5, other), (5, other), (6, (other + " ") * 3000), (7, "Word. " + other)]
    names = ("row", "q", "pattern", "failed", "p_good", "rep", "comp", "digest", "score", "_toxicity")
    ddl = "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame([(d, t, *names) for d, t in rows], ddl)
    for name, stage in C.STAGES[:3]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", *names]
        assert all(tuple(r)[2:] == names for r in docs.collect())
    assert sorted((str(r.doc_id) for r in docs.collect())) == ["1", "5", "None"]
    assert {r.doc_id for r in C.pack_sequences(spark, docs, SF).collect()} == {1, 5, None}
