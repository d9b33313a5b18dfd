"""Properties the queries do not show: shuffles carry labels, partitioning changes nothing, edge cases have defined results."""

import io
import json
import tarfile

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from askwright.functions import arrays as A
from askwright.functions import sampling as S
from askwright.functions import text as T
from askwright.operators import convert, joins, metrics, scoring, spatial
from askwright.operators import questions as Q
from askwright.sources import readers, writers
from askwright.sources.games import rollouts


def test_shuffle_keeps_label_and_probabilities_together(spark):
    df = spark.createDataFrame([(i, ["a", "b", "c", "d"], i % 4, [0.1, 0.2, 0.3, 0.4]) for i in range(40)], "id int, options array<string>, label int, probs array<double>")
    for r in Q.shuffle_options(df, "s", "id", probs="probs").collect():
        assert r.options[r.label] == "abcd"[r.id % 4]
        assert [{"a": 0.1, "b": 0.2, "c": 0.3, "d": 0.4}[o] for o in r.options] == r.probs


def test_rotations_of_equal_options_take_the_first(spark):
    df = spark.createDataFrame([("x", ["a", "b", "a"], 2)], "id string, options array<string>, answer int")
    assert sorted((r.rot, r.label) for r in Q.rotate(df).collect()) == [(0, 0), (1, 1), (2, 0)]


def test_scores_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, f"near {i % 3}", ["near", "far", str(i % 3)]) for i in range(30)], "id int, state string, options array<string>")
    told = [sorted(map(tuple, (tuple(map(str, r)) for r in scoring.score(df.repartition(n), "overlap", ["state", "options"]).collect()))) for n in (1, 7)]
    assert told[0] == told[1]


def test_teacher_last_duplicate_wins_and_null_keys_match(spark):
    rows = spark.createDataFrame([(1, None, "q", 2), (2, "a", "q", 3), (3, "b", "q", 2)], "id int, media string, ask string, k int")
    teacher = spark.createDataFrame([(None, "q", 1, [0.5, 0.5]), (None, "q", 2, [0.1, 0.9]), ("a", "q", 1, [0.2, 0.8])], "media string, ask string, ord int, probs array<double>")
    told = {r.id: r.probs for r in joins.attach_teacher(rows, teacher, ["media", "ask"]).collect()}
    assert told == {1: [0.1, 0.9], 2: None, 3: None}


def test_confidence_and_answers(spark):
    df = spark.createDataFrame([(1, "choice", [0.0, 0.0], 1.0), (2, "choice", [5.0], 1.0), (3, "noul", [0.0, 3.0], 1.0), (4, "score", [0.0, 0.0, 0.0], 1.0)], "id int, type string, logits array<double>, temperature double")
    told = {r.id: r for r in metrics.answers(df).collect()}
    assert (told[1].confidence, told[1].choice) == (0.0, "0")
    assert told[2].confidence == 1.0
    assert told[3].noul == told[3].confidence == 0.9526
    assert told[4].score == 1.0


def test_nearest_is_exact_for_any_block(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<double>")
    told = [sorted((r.vec_id, r.rank, r.other) for r in joins.nearest(df, 3, 0.8, block=b).collect()) for b in (1000, 9)]
    assert told[0] == told[1] and len(told[0]) > 100


def test_overlap_reads_train_rows_only(spark):
    rows = [("e1", "i1", "Is it?", "test"), ("e2", "i1", "Other", "test"), ("e3", "i2", "Is it?", "test"), ("t1", "i1", "is IT!", "train"), ("t2", "i2", "x", None)]
    df = spark.createDataFrame(rows, "id string, image string, text string, split string")
    assert {r.id: r.tag for r in joins.overlap(df.where("split = 'test'"), df).collect()} == {"e1": "question", "e2": "image"}


def test_stratified_split_takes_at_least_one(spark):
    df = spark.createDataFrame([(i, "a" if i < 2 else "b") for i in range(12)], "id int, label string")
    told = S.stratified_split(df, "label", 0.25, "s", "id").groupBy("label").agg(F.count_if(F.col("split") == "test").alias("n")).collect()
    assert {r.label: r.n for r in told} == {"a": 1, "b": 2}


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("aA.;: \n\t", max_size=12), min_size=1, max_size=5))
def test_normalise_matches_python(spark, texts):
    import re

    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.normalise(F.col("t")).alias("n"))
    for r in df.collect():
        assert r.n == re.sub(r"[^a-z0-9]+", " ", r.t.lower()).strip()


def test_md5_mod20_matches_python(spark):
    import hashlib

    df = spark.createDataFrame([(str(i),) for i in range(200)], "t string")
    for r in df.select("t", S.md5_mod20(F.md5("t")).alias("m")).collect():
        assert r.m == int(hashlib.md5(r.t.encode()).hexdigest(), 16) % 20


def test_temperature_clamp(spark):
    df = spark.createDataFrame([("0.1",), ("9",), ("x",), ("nan",), (None,), ("inf",), ("2",)], "t string")
    assert [r[0] for r in df.select(A.clamp_temperature(F.col("t"))).collect()] == [0.5, 5.0, 1.0, 1.0, 1.0, 1.0, 2.0]


def test_split_captions(spark):
    df = spark.createDataFrame([("A dog barks very loudly. Rain falls on the roof A man speaks to a crowd. Too short.",)], "t string")
    assert df.select(T.captions(F.col("t"))).first()[0] == ["A dog barks very loudly", "Rain falls on the roof", "A man speaks to a crowd"]


def test_context_and_hints(spark):
    df = spark.createDataFrame([("Lecture: x.\nQuestion: why?\nHint: y",), ("Is it?\nAnswer yes or no.\nmore",), ("plain",)], "t string")
    told = [tuple(r[0]) for r in df.select(T.context_and_question(F.col("t"))).collect()]
    assert told[0] == ("Hint: y\nLecture: x.", "why?")
    assert [r[0] for r in df.select(T.without_hints(F.col("t"))).collect()][1:] == ["Is it?", "plain"]


def test_tiles_of_one_are_the_image(spark):
    df = spark.createDataFrame([(10, 7)], "width int, height int")
    assert [(r.left, r.top, r.right, r.bottom) for r in spatial.tiles(df, 1).collect()] == [(0, 0, 10, 7)]


def test_readers(spark, tmp_path):
    (tmp_path / "rows.jsonl").write_text('{"id":"1","question":{"type":"noul","instructions":"q"},"label":1}\n{"id":"2","split":"test","question":{"type":"noul","instructions":"q"},"label":0}\n')
    assert {r.id: r.split for r in readers.question_rows(spark, str(tmp_path / "rows.jsonl")).collect()} == {"1": "train", "2": "test"}
    assert [r.id for r in readers.question_rows(spark, str(tmp_path / "rows.jsonl"), "train", None).collect()] == []
    shards = tmp_path / "shards"
    shards.mkdir()
    with tarfile.open(shards / "a.tar.gz", "w:gz") as tar:
        for name, data in (("x/1.jpg", b"J"), ("x/1.txt", b"one"), ("x/2.txt", b"two")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    members = readers.tar_members(spark, str(shards))
    assert [r.member for r in members.orderBy("at").collect()] == ["x/1.jpg", "x/1.txt", "x/2.txt"]
    assert [(r.stem, bytes(r.txt)) for r in readers.paired_members(members).collect()] == [("x/1", b"one")]
    table = pa.table({"k": [1, 2], "v": ["a", "b"]})
    (tmp_path / "streams").mkdir()
    with pa.OSFile(str(tmp_path / "streams" / "s.arrow"), "wb") as f, pa.ipc.new_stream(f, table.schema) as w:
        w.write_table(table)
    assert sorted(map(tuple, readers.arrow_streams(spark, str(tmp_path / "streams"), "k long, v string").collect())) == [(1, "a"), (2, "b")]
    for label in ("yes", "no"):
        (tmp_path / "labels" / label / "deep").mkdir(parents=True)
        (tmp_path / "labels" / label / "deep" / "f.wav").write_bytes(b"x")
    assert sorted(r.label for r in readers.label_folders(spark, str(tmp_path / "labels")).collect()) == ["no", "yes"]
    doc = {"images": [{"id": 1, "width": 100, "height": 50, "file_name": "a"}], "categories": [{"id": 5, "name": "cat", "supercategory": "animal"}], "annotations": [{"image_id": 1, "category_id": 5, "bbox": [1.0, 2.0, 30.0, 20.0], "area": 600.0, "iscrowd": 0}]}
    (tmp_path / "coco.json").write_text(json.dumps(doc))
    assert readers.annotated_boxes(spark, str(tmp_path / "coco.json")).first()["name"] == "cat"


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, "b", "train")], "id int, kind string, split string")
    assert writers.write_rows(df, str(tmp_path / "rows")) == 2
    assert {r.id: r.split for r in spark.read.json(str(tmp_path / "rows")).collect()} == {1: "test", 2: "train"}
    writers.write_by_kind(df, str(tmp_path / "kinds"))
    assert sorted(p.name for p in (tmp_path / "kinds").iterdir() if p.is_dir()) == ["kind=a", "kind=b"]
    assert writers.append_new(df.select("id", "kind"), str(tmp_path / "log"), ["id"]) == 2
    assert writers.append_new(df.select("id", "kind"), str(tmp_path / "log"), ["id"]) == 0
    media = spark.createDataFrame([(bytearray(b"x"), ".jpg"), (bytearray(b"x"), ".jpg"), (bytearray(b"y"), ".jpg")], "data binary, ext string")
    assert writers.media_by_content(media).count() == 2


@pytest.mark.parametrize("game", ["snake", "bird", "bricks"])
def test_rollouts_repeat_and_score(spark, game):
    a, b = (sorted(map(tuple, rollouts(spark, game, 2, 150).repartition(n).collect())) for n in (1, 3))
    assert a == b and max(json.loads(r[4])["score"] for r in a) > 0


def test_every_converter_family_has_the_row_schema(spark):
    df = spark.createDataFrame([(str(i), ["red", "blue", "green"][i % 3], "train") for i in range(9)], "id string, label string, split string")
    for name in ("imagenet", "vocalsound", "vggsound"):
        rows = convert.CONVERTERS[name](df)
        assert rows.columns[:7] == ["id", "state", "type", "instructions", "criteria", "label", "split"]
        for r in rows.join(df.select("id", F.col("label").alias("want")), "id").where("type = 'choice'").collect():
            assert r.criteria[r.label] == r.want
    fsd = spark.createDataFrame([("1", "Dog,Animal", "train"), ("2", "Rain_and_wind,Weather", "test"), ("3", "Car", "train")], "id string, labels string, split string")
    for r in convert.fsd50k(fsd).where("type = 'choice'").collect():
        assert 2 <= len(r.criteria) <= 4
    music = spark.createDataFrame([("a_1", "A slow song with drums.", 60.0), ("b", "A fast song with drums.", 140.0)], "location string, alt_caption string, bpm double")
    held = spark.createDataFrame([("a", "A calm song with drums.", 100.0)], "location string, alt_caption string, bpm double")
    assert {r.id for r in convert.musicbench(music, held).collect()} == {"a", "b"}
    turns = spark.createDataFrame([(1, ["i"], [("Is it big?", "Yes")])], "id int, images array<string>, texts array<struct<user:string,assistant:string>>")
    assert [(r.type, r.label) for r in convert.cauldron(turns).collect()] == [("noul", 1)]


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "id int, user string, assistant string")
    assert Q.cascade(empty).count() == 0
    assert metrics.metrics(spark.createDataFrame([], "label int, logits array<double>"), ["label"]).count() == 0
    assert joins.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_pooled_questions_draw_from_the_whole_pool(spark):
    rows = [(str(i), i, "What is it?", f"a{i % 90}", "hot") for i in range(900)] + [(f"s{i}", i, "What is it?", f"b{i}", "small") for i in range(4)] + [(f"t{i}", i, "What is it?", f"c{i}", "tiny") for i in range(3)]
    df = spark.createDataFrame(rows, "id string, image_id int, question string, multiple_choice_answer string, question_type string").withColumn("answer_type", F.lit("other"))
    told = {r.id: r for r in convert.vqav2(df).collect()}
    again = {r.id: r.criteria for r in convert.vqav2(df.repartition(5)).collect()}
    assert {i: r.criteria for i, r in told.items()} == again and set(told) == {r[0] for r in rows if r[4] != "tiny"}
    right = {r[0]: r[3] for r in rows}
    assert all(r.criteria[r.label] == right[i] and 2 <= len(set(r.criteria)) == len(r.criteria) <= 4 and len({o[0] for o in r.criteria}) == 1 for i, r in told.items())
    assert {o for i, r in told.items() if i.isdigit() for o in r.criteria if o != right[i]} == {f"a{i}" for i in range(90)}


def test_cascade_draws_from_the_whole_pool(spark):
    turns = spark.createDataFrame([(i, "What is the color of the car?", f"c{chr(97 + i % 20)}") for i in range(300)], "id int, user string, assistant string")
    told = [r for r in Q.cascade(turns).collect() if r.rule == "pool"]
    assert len(told) == 300
    assert len({o for r in told for j, o in enumerate(r.criteria) if j != r.label}) == 20


def test_caption_negatives_are_of_the_split_and_drawn_by_the_row(spark):
    rows = [(f"r{i}", f"A common thing number {chr(97 + i // 26)}{chr(97 + i % 26)}", "train") for i in range(200)] + [(f"s{i}", f"a common thing in test {i}", "test") for i in range(9)]
    rows += [("t0", "zyxw", "test"), ("t1", "Zyxw!", "test"), ("t2", "A Common thing in test 0", "test")]
    df = spark.createDataFrame(rows, "id string, caption string, split string")
    own, split = {r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows}
    of = {r[1]: r[2] for r in rows}
    told = [r for r in convert.captioned(df, "s", "split", "x").collect() if r.type == "choice"]
    wrong = {r.id: [c for k, c in enumerate(r.criteria) if k != r.label] for r in told}
    plain = lambda t: "".join(c for c in t.lower() if c.isalnum())
    assert set(wrong) == set(own) and all(r.criteria[r.label] == own[r.id] for r in told)
    assert all(of[w] == split[i] and plain(w) != plain(own[i]) for i, ws in wrong.items() for w in ws)
    assert len({w for i, ws in wrong.items() if split[i] == "train" for w in ws}) > 90
    assert {len(ws) for ws in wrong.values()} == {1, 2, 3}
    match = [r for r in convert.captioned(df, "s", "split", "x").collect() if r.type == "noul"]
    assert len(match) == len(rows) and 70 < sum(r.label for r in match) < 140 and len({r.instructions.split('"')[0] for r in match}) == 3
    clips = [(f"c{i // 3}", f"the dog barks {'abcdefghi'[i]}", "train") for i in range(9)]
    for r in convert.captioned(spark.createDataFrame(clips, "id string, caption string, split string"), "s", "split", "x").where("type = 'choice'").collect():
        assert {c[0] for c in clips if c[1] in r.criteria} - {r.id}


def test_near_captions_differ_in_text(spark):
    rows = [(f"c{i}", ["A red car here", "a red  car here!", "A blue car here", "A green car there"][i], "train", [1.0, 0.1 * i]) for i in range(4)]
    df = spark.createDataFrame(rows, "id string, caption string, split string, embedding array<double>")
    near = {(r.id, r.other) for r in joins.nearest(df, 3, 9.0, key="id", text="caption").collect()}
    assert near == {(f"c{i}", f"c{j}") for i in range(4) for j in range(4) if i != j and {i, j} != {0, 1}}
    told = convert.cc3m(df.drop("embedding"), df.select("id", "embedding"), max_sim=9.0).where("type = 'choice'").collect()
    of = {"A red car here": {"c0", "c1"}, "a red  car here!": {"c0", "c1"}, "A blue car here": {"c2"}, "A green car there": {"c3"}}
    assert len(told) == 4 and all(of[w] & {o for i, o in near if i == r.id} for r in told for k, w in enumerate(r.criteria) if k != r.label)
