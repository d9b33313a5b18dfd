"""Batches under a budget, labelling that goes on after failures, running counts."""

import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from askwright.operators import scoring, teacher
from askwright.streaming import progress


def lengths(frame):
    return [[float(len(t or "")), float("inf") if t == "bad" else 1.0] if t != "none" else [] for t in frame["text"]]


@pytest.mark.parametrize("budget,most", [(1, 64), (40, 64), (10_000, 3), (10_000, 64)])
def test_answers_do_not_depend_on_the_budget(spark, budget, most):
    rows = [(i, "x" * (i * 7 % 23)) for i in range(100)] + [(100, "bad"), (101, "none"), (102, None), (103, "x" * 500), (104, "bad")]
    df = spark.createDataFrame(rows, "id int, text string").repartition(3)
    told = scoring.score_in_batches(df, lengths, ["text"], F.length("text"), budget, most).collect()
    assert len(told) == len(rows)
    for r in told:
        if r.text in ("bad", "none"):
            assert r.logits is None and r.failure == "logits are not finite"
        else:
            assert list(r.logits) == [float(len(r.text or "")), 1.0] and r.failure is None
        assert r.cost == max(1, len(r.text or "")) <= r.padded
    assert scoring.score_in_batches(df.limit(0), lengths, ["text"], F.length("text")).count() == 0


def test_batches_keep_to_budget_and_number():
    frames = [pd.DataFrame({"__cost": sorted(c)}) for c in ([1] * 10 + [2] * 5, [3] * 4 + [50, 70])]
    made = [b["__cost"].tolist() for b in scoring._padded_batches(iter(frames), 12, 6)]
    assert sum(made, []) == [1] * 10 + [2] * 5 + [3] * 4 + [50, 70]
    assert all(len(b) == 1 or len(b) <= 6 and len(b) * max(b) <= 12 for b in made)


def test_padding_is_little_where_lengths_are_mixed(spark):
    df = spark.range(2000).select("id", F.expr("repeat('x', cast(1 + id * 7919 % 400 as int))").alias("text"))
    told = scoring.score_in_batches(df, lengths, ["text"], F.length("text"), 8000, 64)
    assert scoring.padding_share(told).first().padding < 0.1


def test_media_the_scorer_does_not_take(spark):
    requests = spark.createDataFrame([(1, "s", ["a"], None), (2, "s", None, ["b"]), (3, "s", [], None), (4, None, ["a"], ["b"])], "request_id int, state string, images array<string>, audios array<string>")
    crit = F.array(*[F.struct(F.lit(x).alias("key"), F.lit(None).cast("string").alias("value")) for x in ("a", "b")])
    questions = requests.select("request_id", F.lit("q").alias("qid"), F.struct(F.lit("choice").alias("type"), F.lit("?").alias("instructions"), crit.alias("criteria")).alias("question"), F.lit(1.0).alias("temperature"))
    told = {r.request_id: r for r in scoring.predict_in_batches(requests, questions, "overlap", F.length("state"), ("image",)).collect()}
    assert [told[i].modalities for i in (1, 2, 3, 4)] == ["image", "audio", "text", "image+audio"]
    assert told[1].choice == "a" and told[3].choice == "a" and told[1].error is None
    assert told[2].error == told[4].error == "the scorer takes no audio" and told[2].choice is None
    without = scoring.predict_in_batches(requests.drop("images", "audios"), questions, "overlap", F.length("state"))
    assert {r.modalities for r in without.collect()} == {"text"}


def variants():
    return F.array(F.array(F.lit("A")), F.array(F.lit("B")))


def test_labelling_goes_on_after_a_killed_run(spark, tmp_path):
    path = str(tmp_path / "labels")
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else f"k{i}") for i in range(60)] + [(5, "k5"), (5, "k5")], "id int, k string")
    counts = tmp_path / "asked"

    def client(row):
        with open(counts, "a") as f:
            f.write(f"{int(row['id'])}\n")
        if row["id"] % 10 == 7:
            raise TimeoutError("late")
        if row["id"] % 10 == 8:
            return [("?", -1.0)]
        return [("A", -0.5), ("B", -1.5)]

    def killed(row):
        if row["id"] == 41:
            raise KeyboardInterrupt  # ends the task, and the job with it
        return client(row)

    with pytest.raises(Exception, match="KeyboardInterrupt|Job aborted|stage failure|Python worker"):
        teacher.label_rows(rows, killed, path, ["id", "k"], variants(), portions=6, tasks=2, pause=0.0)
    done = {r.id for r in spark.read.parquet(path).collect()} if (tmp_path / "labels").exists() else set()
    told = teacher.label_rows(rows, client, path, ["id", "k"], variants(), portions=6, tasks=2, attempts=2, pause=0.0)
    assert told == {"labelled": 48 - len(done), "failed": 6, "unanswered": 6}
    kept = spark.read.parquet(path).collect()
    assert len(kept) == 48 and len({r.id for r in kept}) == 48
    assert kept[0].teacher.probs == [0.73106, 0.26894] and kept[0].teacher.mass == 0.8297 and kept[0].teacher.model == "teacher"
    again = teacher.label_rows(rows, client, path, ["id", "k"], variants(), portions=6, tasks=2, attempts=1, pause=0.0)
    assert again == {"labelled": 0, "failed": 6, "unanswered": 6}
    asked = counts.read_text().split()
    # what a killed portion had asked for is asked again; nothing else that was answered is
    assert asked.count("7") >= 3 and all(asked.count(str(i)) <= 2 for i in range(60) if i % 10 < 7)
    assert all(asked.count(str(i)) == 1 for i in done)


def test_requests_in_flight_are_bounded(spark):
    def client(row):
        begun = time.time()
        time.sleep(0.02)
        return [("A", begun), ("B", time.time())]

    told = teacher.asked(spark.range(60).coalesce(1), client, in_flight=4).collect()
    spans = [(r.top[0].logprob, r.top[1].logprob) for r in told]
    most = max(sum(a <= x < b for a, b in spans) for x, _ in spans)
    assert 2 <= most <= 4
    assert teacher.asked(spark.range(0), client).count() == 0


def test_running_counts_go_on(spark, tmp_path):
    path = str(tmp_path)
    schema = "part int, label int, probs array<double>"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    run = lambda: progress.running_progress(spark, f"{path}/in", schema, f"{path}/out", f"{path}/checkpoint", "part")
    write([(1, 0, [0.9, 0.1]), (1, 0, [0.1, 0.9]), (2, 1, None)])
    run()
    assert sorted(map(tuple, progress.latest_progress(spark, f"{path}/out", "part").collect())) == [(1, 2, 0, 1, 0.5), (2, 0, 1, 0, 0.0)]
    write([(1, 1, [0.2, 0.8]), (None, 0, [1.0, 0.0])])
    run()
    run()
    told = sorted(map(tuple, progress.latest_progress(spark, f"{path}/out", "part").collect()), key=str)
    assert told == [(1, 3, 0, 2, 0.666667), (2, 0, 1, 0, 0.0), (None, 1, 0, 1, 1.0)]
