"""JSON arrays and tar files by ranges of bytes against reading them whole."""

import io
import json
import random
import tarfile

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from askwright.sources import ranges, readers

ODD = ["a", '"', "\\", "\\\\", '\\"', "],[", "}{", ",", "é", " ", "annotations", ": [", "\n", "x" * 70]


def odd_value(rng, depth=0):
    kind = rng.randrange(6 if depth < 3 else 4)
    if kind < 2:
        return "".join(rng.choice(ODD) for _ in range(rng.randrange(4)))
    if kind == 2:
        return rng.choice([1, -2.5, None, True])
    if kind == 3:
        return {}
    if kind == 4:
        return [odd_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {"".join(rng.choice(ODD) for _ in range(2)) + str(i): odd_value(rng, depth + 1) for i in range(rng.randrange(4))}


@pytest.mark.parametrize("indent", [None, 2])
def test_json_elements_at_every_cut(spark, tmp_path, indent):
    rng = random.Random(5)
    for trial, n in enumerate((0, 1, 40)):
        items = [odd_value(rng) for _ in range(n)]
        doc = {"info": {"annotations": [[1], "no"]}, 'tricky \\"annotations': [9, 8], "images": [{"id": 1}], "annotations": items, "last": ["x"], "n": "annotations"}
        path = tmp_path / f"{trial}.json"
        path.write_text(json.dumps(doc, indent=indent, ensure_ascii=trial % 2 == 0))
        for size in (17, 100, 1 << 20) if n else (64,):
            told = ranges.json_elements(spark, str(path), "annotations", size).orderBy("at").collect()
            assert [json.loads(r.value) for r in told] == items, size
        assert [json.loads(r.value) for r in ranges.json_elements(spark, f"file://{path}", "last", 50).collect()] == ["x"]
        assert ranges.json_elements(spark, str(path), "nowhere", 64).count() == 0


def test_outermost_arrays_and_repeated_keys(spark, tmp_path):
    (tmp_path / "list.json").write_text(' [ 1, "a,b", [2, 3] , {"a": [4]} ] ')
    assert [r.value for r in ranges.json_elements(spark, str(tmp_path / "list.json"), None, 7).orderBy("at").collect()] == ["1", '"a,b"', "[2, 3]", '{"a": [4]}']
    (tmp_path / "twice.json").write_text('{"a": [1, 2], "b": 0, "a": [3]}')
    assert [r.value for r in ranges.json_elements(spark, str(tmp_path / "twice.json"), "a", 8).collect()] == ["3"]
    (tmp_path / "empty.json").write_text("")
    assert ranges.json_elements(spark, str(tmp_path / "empty.json"), "a").count() == 0


def test_boxes_as_read_in_one_piece_by_many_tasks(spark, tmp_path):
    rng = random.Random(6)
    doc = {
        "images": [{"id": i, "width": 640, "height": 480, "file_name": f"{i}.jpg"} for i in range(50)],
        "annotations": [{"id": k, "image_id": rng.randrange(55), "category_id": rng.randrange(6), "bbox": [rng.randrange(99) + 0.5, 2, 3, 4], "area": 12, **({"iscrowd": rng.randrange(2)} if k % 3 else {})} for k in range(2000)],
        "categories": [{"id": c, "name": f'c"{c}', "supercategory": "s"} for c in range(5)],
    }
    path = str(tmp_path / "boxes.json")
    with open(path, "w") as f:
        json.dump(doc, f)
    want = readers.annotated_boxes(spark, path)
    told = ranges.annotated_boxes(spark, path, 4096)
    key = lambda df: sorted(map(repr, df.select(*want.columns).collect()))
    assert told.columns == want.columns and key(told) == key(want)
    parts = ranges.json_elements(spark, path, "annotations", 4096).select(F.spark_partition_id()).distinct().count()
    assert parts > 20


def make_tar(path, members, mode="w"):
    with tarfile.open(path, mode) as tar:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
        link = tarfile.TarInfo("link")
        link.type, link.linkname = tarfile.SYMTYPE, "0.jpg"
        tar.addfile(link)


def test_one_shard_by_many_tasks(spark, tmp_path):
    rng = random.Random(7)
    members = [(f"{'d' * 120}/{i}.{'jpg' if i % 2 else 'txt'}", rng.randbytes(rng.choice([0, 1, 511, 512, 513, 5000]))) for i in range(200)]
    make_tar(tmp_path / "a b.tar", members)
    make_tar(tmp_path / "second.tar", members[:3])
    paths = [str(tmp_path / "a b.tar"), str(tmp_path / "second.tar")]
    index = ranges.tar_index(spark, paths)
    told = ranges.members_by_range(index, 8, 20_000)
    got = {(r.shard, r["at"]): (r.member, bytes(r.data)) for r in told.collect()}
    assert got == {(p, i): m for p, ms in zip(paths, (members, members[:3]), strict=True) for i, m in enumerate(ms)}
    assert told.where(F.col("shard") == paths[0]).select(F.spark_partition_id()).distinct().count() > 3
    some = ranges.members_by_range(index.where(F.col("member").endswith(".txt") & (F.col("size") > 512)), 3)
    assert {bytes(r.data) for r in some.collect()} == {d for n, d in members if n.endswith("txt") and len(d) > 512}
    pairs = readers.paired_members(told.select("shard", "member", "data"))
    assert pairs.count() == 0  # stems differ
    assert ranges.members_by_range(ranges.tar_index(spark, []), 2).count() == 0


def test_compressed_and_short_shards_are_errors(spark, tmp_path):
    make_tar(tmp_path / "z.tar", [("a", b"x" * 9000)], "w:gz")
    with pytest.raises(PythonException):
        ranges.tar_index(spark, [str(tmp_path / "z.tar")]).count()
    make_tar(tmp_path / "s.tar", [("a", b"x" * 9000)])
    index = ranges.tar_index(spark, [str(tmp_path / "s.tar")])
    rows = spark.createDataFrame(index.collect(), index.schema)
    (tmp_path / "s.tar").write_bytes((tmp_path / "s.tar").read_bytes()[:4000])
    with pytest.raises(PythonException, match="cut short"):
        ranges.members_by_range(rows, 1).collect()
