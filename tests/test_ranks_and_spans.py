"""Places within groups against plain sorting, and binned interval joins against comparing everything."""

import random

import pytest
from pyspark.sql import functions as F

from askwright.functions import sampling as S
from askwright.functions.ranks import places
from askwright.operators import assembly as A


def test_places_in_a_hot_group_with_nulls_and_repeated_rows(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else rng.choice(["a", None, "b"]), rng.choice([None, 1, 2, 3]), i // 2) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, o int, at long").repartition(7)
    told = places(df, ["g"], ["o", "at"], "place", "of").collect()
    assert len(told) == len(rows)
    for g in ("hot", "a", "b", None):
        mine = sorted(([r.o if r.o is not None else -1, r["at"]], r.place) for r in told if r.g == g)
        assert sorted(p for _, p in mine) == list(range(len(mine)))
        by_place = [k for k, p in sorted(mine, key=lambda x: x[1])]
        assert by_place == sorted(by_place) and {r.of for r in told if r.g == g} == {len(mine)}
    parts = places(df, ["g"], ["at"], "place", "of")
    assert parts.select(F.spark_partition_id()).distinct().count() > 1
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan.split("BroadcastExchange")[0]  # only the counts of partitions go through a window


def test_places_without_groups_and_of_nothing(spark):
    df = spark.range(100).select("id", (-F.col("id")).alias("o"))
    assert all(r["at"] == 99 - r.id and r.of == 100 for r in places(df, [], ["o"]).collect())
    assert places(df.limit(0), ["id"], ["o"]).count() == 0 and S.halves(df.limit(0), ["id"], ["o"]).count() == 0


@pytest.mark.parametrize("n", [1, 7, 400])
def test_split_takes_the_rounded_share(spark, n):
    df = spark.range(n).select("id", F.lit("one").alias("label"), F.lit("x").alias("__mine"))
    told = S.stratified_split(df, "label", 0.2, "s", "id")
    assert told.where("split = 'test'").count() == max(1, round(n * 0.2)) and told.columns == ["id", "label", "__mine", "split"]


def test_spans_of_all_lengths(spark):
    rng = random.Random(2)
    spans = [(i, rng.choice("xy"), lo := rng.randrange(-300, 5000), lo + rng.choice([0, -3, 1, 15, 16, 17, 255, 256, 300, 4096])) for i in range(300)] + [(900, "x", None, 5), (901, None, 0, 9), (902, "x", 3, None)]
    frames = [(rng.choice("xyz"), rng.randrange(-310, 9200), i) for i in range(2000)] + [("x", None, 5000), (None, 4, 5001)]
    told = A.frames_of(spark.createDataFrame(spans, "id int, store string, lo int, hi int"), spark.createDataFrame(frames, "store string, frame int, row int"))
    want = sorted((i, r) for i, s, lo, hi in spans for t, f, r in frames if None not in (s, lo, hi, t, f) and s == t and lo <= f < hi)
    assert sorted((r.id, r.row) for r in told.select("id", "row").collect()) == want
    none = spark.createDataFrame([], "id int, store string, lo int, hi int")
    assert A.frames_of(none, spark.createDataFrame(frames, "store string, frame int, row int")).count() == 0


def test_a_span_of_a_million_frames_is_a_few_rows(spark):
    spans = spark.createDataFrame([(i, "x", i, i + 1_000_000) for i in range(50)], "id int, store string, lo long, hi long")
    frames = spark.createDataFrame([("x", 10_000 * i) for i in range(110)], "store string, frame long")
    told = A.frames_of(spans, frames)
    assert told.count() == sum(i <= 10_000 * j < i + 1_000_000 for i in range(50) for j in range(110))
    rows = told._jdf.queryExecution().optimizedPlan().toString()
    assert "shiftright" in rows
    cut = spans.select(F.explode(F.sequence(F.shiftright("lo", 16), F.shiftright(F.col("hi") - 1, 16))))
    assert cut.count() <= 50 * 17
