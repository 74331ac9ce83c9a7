"""Joins of rows with the table of their classes when a few classes hold very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a class from which on its look-up is spread over ``SALTS`` tasks.
HEAVY, SALTS = 5_000, 64


def join_classes(rows: DataFrame, classes: DataFrame, keys: list[str], spread: str, copies: str = "copies") -> DataFrame:
    """``rows`` with the columns of their class (inner join on ``keys``, unique in ``classes``).  Classes of
    more than ``HEAVY`` rows (``copies``) stand under ``SALTS`` salts, and rows meet them by a hash of the
    column ``spread``; all others meet in a second, plain join."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    heavy = classes.where(F.col(copies) > HEAVY).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = salted.join(heavy.withColumn("_met", F.lit(True)), [*keys, "_salt"], "left")
    light = met.where("_met is null").select(*rows.columns).join(classes.where(F.col(copies) <= HEAVY), keys)
    return met.where("_met").drop("_salt", "_met").unionByName(light)
