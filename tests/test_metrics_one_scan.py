"""engagement strings are scanned once, with the results of the item pattern."""

import random
import re

from pyspark.sql import functions as F

from postlens.functions import parse as PA

ITEM = re.compile(r"([0-9.,]+)\s*(rb|jt)?\s*([a-z\s]+?)\s*(?=,|\Z)")


def slow(s):
    out = dict.fromkeys(PA.METRICS)
    for num, unit, label in ITEM.findall(s.lower()):
        if label in PA.METRIC_LABELS:
            parts = num.replace(",", ".").split(".")
            lead = ".".join(parts[:2])
            value = float(lead) if any(map(str.isdigit, lead)) else None
            value = None if value is None else int(value * {"rb": 1e3, "jt": 1e6}.get(unit, 1) + 0.5 // 1)
            out[PA.METRIC_LABELS[label]] = value
    return tuple(out.values())


def test_random_strings_and_marks(spark):
    rng = random.Random(7)
    bits = ["1", "25", ".", ",", ", ", " ", "  ", "\t", " ", "rb", " jt ", "suka", "Suka", "posting ulang", "posting  ulang", "tayangan",
            "balasan", "markah", "x", "#", "\x01", "\x02", "\x03", "\n", "3 suka, 4 rb suka", "é"]
    texts = ["", "5 rb ,", "5 rb", "7 suka\x02, 8 suka", "1\x01rb\x01suka\x02", *("".join(rng.choices(bits, k=rng.randint(1, 9))) for _ in range(3000))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", PA.parse_metrics("s").alias("m"))
    for r in df.collect():
        assert tuple(r["m"]) == slow(texts[r["i"]]), repr(texts[r["i"]])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and plan.count("regexp_replace") == 1
    assert spark.range(1).select(PA.parse_metrics(F.lit(None).cast("string")).alias("m")).first()["m"] is None
