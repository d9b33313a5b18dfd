"""Readers, writers and the windowed stream on files made here."""

import io
import json
import tarfile
import zlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from askwright.operators import assembly
from askwright.sources import readers, writers
from askwright.sources.games import game_questions
from askwright.streaming import append


@pytest.fixture
def tree(tmp_path):
    card = json.dumps({"info": {"features": {"label": {"names": ["cat", "dog"]}}}})
    for name, ids in (("b/train-1", [1, 2]), ("a/val-1", [3]), ("a/test-1", [4])):
        path = tmp_path / "tree" / f"{name}.parquet"
        path.parent.mkdir(parents=True, exist_ok=True)
        t = pa.table({"id": ids, "label": [0] * len(ids)})
        pq.write_table(t.replace_schema_metadata({"huggingface": card}), path)
    return str(tmp_path / "tree")


def test_parquet_tree_splits_prunes_and_keeps_places(spark, tree):
    rows = readers.parquet_tree(spark, tree, ["id"], position=True)
    assert rows.columns == ["id", "split", "file", "row"]
    assert [(r.id, r.split) for r in rows.orderBy("file", "row").collect()] == [(4, "test"), (3, "test"), (1, "train"), (2, "train")]
    assert readers.parquet_tree(spark, tree).columns == ["id", "label", "split"]
    plan = readers.parquet_tree(spark, tree, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint>" in plan


def test_scan_ends_when_every_split_has_its_rows(spark, tmp_path):
    for i in range(12):
        name = f"{'test' if i % 4 == 3 else 'train'}-{i:02d}.parquet"
        pq.write_table(pa.table({"id": [10 * i + k for k in range(10)], "clash": ["x"] * 10}), tmp_path / name)
    (tmp_path / "train-99.parquet").write_bytes(b"a file that no round gets to")
    told = readers.parquet_tree_until(spark, str(tmp_path), {"train": 25, "test": 5}, ["id"])
    got = [(r.split, r.id) for r in told.orderBy("split", "file", "row").collect()]
    train = [10 * i + k for i in range(12) if i % 4 < 3 for k in range(10)]
    assert got == [("test", 30 + k) for k in range(5)] + [("train", n) for n in train[:25]]
    assert len({f for f in told.inputFiles()}) < 8
    assert readers.parquet_tree_until(spark, str(tmp_path), {"test": 1000}, ["id"]).count() == 30
    assert readers.parquet_tree_until(spark, str(tmp_path), {"train": 0}, ["id"]).count() == 0


def test_class_names_from_the_footer(spark, tree, tmp_path):
    assert readers.class_names(spark, tree, "label") == ["cat", "dog"]
    assert readers.class_names(spark, tree, "id") == []
    spark.range(1).write.parquet(str(tmp_path / "plain"))
    assert readers.class_names(spark, str(tmp_path / "plain"), "label") == []


def test_csv_and_label_folders(spark, tmp_path):
    (tmp_path / "x.csv").write_text('file,label\n"a, b",1\nc,\n')
    assert [tuple(r) for r in readers.csv_examples(spark, str(tmp_path / "x.csv")).collect()] == [("a, b", "1"), ("c", None)]
    for label in ("bark", "rain"):
        (tmp_path / "folders" / label / "deep").mkdir(parents=True)
        (tmp_path / "folders" / label / "deep" / "1.wav").write_bytes(b"x")
    told = readers.label_folders(spark, str(tmp_path / "folders")).collect()
    assert sorted(r.label for r in told) == ["bark", "rain"] and all(r.file.endswith("deep/1.wav") for r in told)


@pytest.mark.parametrize("mode", ["w", "w:gz"])
def test_tar_members_of_any_size_in_archive_order(spark, tmp_path, mode):
    big = bytes(range(256)) * (70 << 12)  # 70 MB
    with tarfile.open(tmp_path / "s 1.tar", mode) as tar:
        for name, data in (("z.txt", b"last"), ("a.bin", big), ("m.txt", b"")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    digest = F.crc32("data").alias("crc")
    told = readers.tar_members(spark, str(tmp_path)).select("at", "member", digest).orderBy("at").collect()
    assert [(r.at, r.member) for r in told] == [(0, "z.txt"), (1, "a.bin"), (2, "m.txt")]
    assert told[1].crc == zlib.crc32(big)
    small = readers.tar_members(spark, str(tmp_path), r"\.(txt|bin)$", limit_bytes=1 << 20).collect()
    assert sorted(r.member for r in small) == ["m.txt", "z.txt"]


def test_tar_members_report_a_broken_shard(spark, tmp_path):
    (tmp_path / "x.tar").write_bytes(b"not a tar file" * 100)
    with pytest.raises(PythonException):
        readers.tar_members(spark, str(tmp_path)).collect()


def test_arrow_streams_are_mapped(spark, tmp_path):
    t = pa.table({"k": pa.array([1, 2, 3], pa.int64()), "v": ["a", None, "c"]})
    for name in ("one", "two"):
        with pa.ipc.new_stream(str(tmp_path / name), t.schema) as out:
            out.write_table(t, max_chunksize=2)
    rows = readers.arrow_streams(spark, str(tmp_path), "k long, v string").collect()
    assert sorted((r.k, r.v or "") for r in rows) == [(1, "a"), (1, "a"), (2, ""), (2, ""), (3, "c"), (3, "c")]


def test_feature_store_round_trip(spark, tmp_path):
    frames = spark.createDataFrame([(p, f, [float(f), 1.0]) for p, n in (("hot", 50), ("x", 2), ("y", 1)) for f in range(n)], "path string, frame int, vec array<double>")
    spans = writers.write_features(frames.repartition(3), str(tmp_path), "s1")
    assert sorted(map(tuple, spans.collect())) == [("hot", 0, 50, 2), ("x", 0, 2, 2), ("y", 0, 1, 2)]
    writers.write_features(frames.where("path = 'x'").withColumn("frame", F.col("frame") + 7), str(tmp_path), "s0")
    both = readers.feature_frames(spark, str(tmp_path), ["s0", "s1"])
    assert sorted((r.path, r.frame) for r in both.where("path <> 'hot'").collect()) == [("x", 7), ("x", 8), ("y", 0)]
    some = spark.createDataFrame([("hot", 3, 5), ("y", 0, 1), ("x", 1, 1)], "path string, lo int, hi int")
    store = readers.feature_frames(spark, str(tmp_path), ["s1"])
    assert sorted((r.path, r.frame, r.vec[0]) for r in assembly.frames_of(some, store, store="path").collect()) == [("hot", 3, 3.0), ("hot", 4, 4.0), ("y", 0, 0.0)]


def test_report_is_updated_in_place(spark, tmp_path):
    path = tmp_path / "config.json"
    writers.update_report(spark, str(path), a=1, b={"x": "é"})
    writers.update_report(spark, str(path), a=[2.5], c=None)
    assert json.loads(path.read_text()) == {"a": [2.5], "b": {"x": "é"}, "c": None}
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["config.json"]


def test_media_names_by_either_digest(spark):
    import hashlib

    media = spark.createDataFrame([(b"x", ".jpg"), (b"x", ".jpg"), (b"y", ".jpg")], "data binary, ext string")
    for digest in ("sha1", "md5"):
        told = {r.file: r.n for r in writers.media_by_content(media, digest=digest).collect()}
        assert told == {getattr(hashlib, digest)(d).hexdigest()[:16] + ".jpg": n for d, n in ((b"x", 2), (b"y", 1))}


def test_game_questions_follow_the_spec(spark, tmp_path):
    spec = {"state": "A game.", "questions": {"snake": {"instructions": ["Go?", "Which way?"], "labels": [["up", "down", "left"], ["N", "S", "W"]]}}}
    (tmp_path / "questions.json").write_text(json.dumps(spec, indent=2))
    rows = [{"image": f"snake/{i}.png", "label": i % 3, "split": "test" if i % 10 == 0 else "train"} for i in range(100)]
    (tmp_path / "snake.jsonl").write_text("\n".join(map(json.dumps, rows)))
    plain = game_questions(spark, str(tmp_path), "snake", "test", augment=False).collect()
    assert len(plain) == 10 and {(r.instructions, tuple(r.options), r.source, r.state) for r in plain} == {("Go?", ("up", "down", "left"), "game:snake", "A game.")}
    drawn = game_questions(spark, str(tmp_path), "snake", "train").collect()
    assert len(drawn) == 90 and {r.instructions for r in drawn} == {"Go?", "Which way?"}
    right = {r["image"]: r["label"] for r in rows}
    assert all(r.options[r.label] in [s[right[r.image]] for s in (["up", "down", "left"], ["N", "S", "W"])] for r in drawn)
    assert len({tuple(r.options) for r in drawn}) > 4


def test_texts_are_scanned_without_media(spark, tmp_path):
    spark.createDataFrame([(1, "a", b"m1"), (2, "b", b"m2"), (3, "a", None)], "key int, caption string, media binary").write.parquet(str(tmp_path / "p"))
    source = spark.read.parquet(str(tmp_path / "p"))
    rows = assembly.with_media(source.where("caption = 'a'").select("key", "caption"), source, "key", ["media"])
    assert sorted((r.key, r.media) for r in rows.collect()) == [(1, b"m1"), (3, None)]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<key:int,caption:string>" in plan and "ReadSchema: struct<key:int,media:binary>" in plan


def test_windowed_counts_write_windows_that_are_over(spark, tmp_path):
    rows = [(f"2024-01-0{d} 10:00:00", k) for d, k in ((1, "x"), (1, "x"), (1, "y"), (2, "x"), (9, "z"))]
    spark.createDataFrame(rows, "ts string, event_type string").coalesce(1).write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    append.windowed_counts(spark, str(tmp_path / "in"), "ts string, event_type string", out, str(tmp_path / "state"))
    told = append.appended(spark, out, "start timestamp, event_type string, n long").collect()
    assert sorted((str(r.start)[:10], r.event_type, r.n) for r in told) == [("2024-01-01", "x", 2), ("2024-01-01", "y", 1), ("2024-01-02", "x", 1)]
