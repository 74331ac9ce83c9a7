"""texts are read and tokenised once for all fits."""

from pyspark.sql import functions as F

from postlens.operators import classify as C


def _posts(spark, reads):
    def seen(text):
        reads.add(1)
        return text
    rows = [(i, f"kata {'baik' if i % 3 else 'buruk'} umum nomor{i % 5}", 1 if i % 3 else 0) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, plain string, label int")
    return rows, df.select("id", "label", F.udf(seen, "string")("plain").alias("text"))


def test_every_text_is_read_once(spark):
    reads = spark.sparkContext.accumulator(0)
    rows, df = _posts(spark, reads)
    model, table = C.train_classifier(df, "text", "label", "id", (0, 1), "binary", regs=(0.01, 0.1))
    assert reads.value == len(rows)
    assert [(r["reg_param"], r["macro_f1"], r["accuracy"]) for r in table.collect()] == [(0.01, 1.0, 1.0), (0.1, 1.0, 1.0)]
    again = spark.createDataFrame(rows, "id long, text string, label int")
    assert all(r["pred"] == r["label"] for r in C.score(model, again).collect())


def test_focal_reads_every_text_once(spark):
    reads = spark.sparkContext.accumulator(0)
    rows, df = _posts(spark, reads)
    model = C.train_focal(df, "text", "label", (0, 1), rounds=2)
    assert reads.value == len(rows)
    again = spark.createDataFrame(rows, "id long, text string, label int")
    assert all(r["pred"] == r["label"] for r in C.score(model, again).collect())
