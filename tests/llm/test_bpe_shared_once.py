"""The shared words come to the driver in one job: a job per partition shipped the rank tables each time."""
import public_tokenizers as P

from postlens.llm import byte_bpe
from postlens.session import checkpoint_dir


def test_jobs_do_not_grow_with_partitions(spark):
    checkpoint_dir(spark)
    path = P.path("byte_bpe_50k.tiktoken")
    df = spark.createDataFrame([(i, f"the same words {i % 7} again, ünd {i % 5} more") for i in range(60)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    jobs, tables = [], []
    try:
        for n in (2, 16):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            spark.sparkContext.setJobGroup(f"shared-{n}", "")
            tables.append(byte_bpe.shared_table(df, path, P.PATTERN))
            jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"shared-{n}")))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert jobs[0] == jobs[1]
    ranks = byte_bpe.load_ranks(path)
    for t in tables:
        words, at = t.index(), [0, *t.id_ends]
        assert len(t) == len(words) == len(t.id_ends) and " same" in words and " ünd" in words
        for w, k in words.items():
            assert t.ids[at[k]:at[k + 1]].tolist() == byte_bpe.heap_merges(ranks, w.encode())
