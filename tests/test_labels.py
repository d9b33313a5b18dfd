"""Wrong labels by numbers: right sides, nothing twice, label sets that run out, and a large one."""

import pytest
from pyspark.sql import functions as F

from askwright.operators import labels as L

NAMES = ["people marching", "people running", "dog barking", "dog howling", "rain", "wind chime", "chime bell", "engine idling", None]


def told(spark, rows, names, **options):
    df = spark.createDataFrame(rows, "id int, label string").repartition(3)
    vocabulary = spark.createDataFrame([(n,) for n in names], "label string")
    return {r.id: r for r in L.wrong_labels(df, vocabulary, "id", "label", **options).collect()}


def test_sides_and_numbers(spark):
    rows = [(i, NAMES[i % 8]) for i in range(400)] + [(900, None), (901, "unknown label")]
    got = told(spark, rows, NAMES + NAMES)
    assert sorted(got) == list(range(400))
    near = 0
    for i, label in rows[:400]:
        r = got[i]
        assert len(r.wrong) == len(set(r.wrong)) == 3 and label not in r.wrong and set(r.wrong) <= set(NAMES)
        shares = [bool(set(label.split()) & set(w.split())) for w in r.wrong]
        assert shares == [True] * r.n_near + [False] * (3 - r.n_near)
        near += r.n_near
    assert got[4].n_near == 0 and near > 150  # rain shares no word
    assert told(spark, rows, NAMES) == got  # repeated labels, another partitioning
    drawn = {w for i, label in rows[:400] if label == "rain" for w in got[i].wrong}
    assert drawn == set(NAMES) - {"rain", None}


@pytest.mark.parametrize("names", [["a b"], ["a b", "b c"], ["a b", "c d"]])
def test_small_sets_run_out(spark, names):
    got = told(spark, [(1, "a b")], names)
    assert (got[1].wrong if got else []) == names[1:] if len(names) > 1 else not got


def test_a_large_set_costs_a_row_what_a_small_one_does(spark):
    """Rows in the joins grow with rows and draws, not with the label set."""
    vocabulary = spark.range(60_000).select(F.concat(F.lit("word"), (F.col("id") % 700).cast("string"), F.lit(" thing"), F.col("id").cast("string")).alias("label"))
    rows = vocabulary.withColumn("id", F.monotonically_increasing_id()).where("id % 40 = 0")
    n = rows.count()
    got = L.wrong_labels(rows, vocabulary, "id", "label").agg(F.count("*").alias("n"), F.min(F.size("wrong")).alias("least"), F.avg("n_near").alias("near")).first()
    assert got.n == n and got.least == 3 and 1.2 < got.near < 1.8
