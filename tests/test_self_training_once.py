"""Splits and sample of a self-training round are made once: every later step made them again."""
import pytest


def test_rows_of_the_round_are_made_once(spark, monkeypatch):
    from postlens.operators import classify as C
    from postlens.operators import vectors as V

    class Seen(Exception):
        pass

    def stop(both, *_):
        raise Seen(both._jdf.queryExecution().optimizedPlan().toString(), both.count())
    monkeypatch.setattr(V, "embed_text", stop)
    posts = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "tweet_id long, content string")
    train, test = (posts.where(f"tweet_id % 4 = {k}").selectExpr("*", "1 sentiment") for k in (0, 1))
    with pytest.raises(Seen) as seen:
        C.self_training_round(posts, train, test, 3)
    plan, n = seen.value.args
    assert n == 8 and "Join" not in plan and "Window" not in plan
