"""Large files read by ranges of bytes: elements of one JSON array, members of a tar file.

A file of any size is read by many tasks, each of which opens it through Arrow's file systems (mounted paths, s3, gs, hdfs) and reads its
ranges only.  The driver handles a few numbers for each range.
"""

from __future__ import annotations

import re
import tarfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE = 8 << 20


def _file(path: str):
    """The file, open for reading at any place."""
    from pyarrow import fs

    if re.match(r"[a-z0-9]+:", path) and not path.startswith("file:"):
        system, name = fs.FileSystem.from_uri(path)
    else:
        system, name = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return system.open_input_file(name)


# What a range of JSON bytes does to the state of a reader: whether it is inside a string, and how deep in arrays and objects


def _quotes(data: np.ndarray, before: bytes) -> np.ndarray:
    """Places of the quotes that begin or end strings; ``before`` is what stands in front, to its last byte that is no backslash."""
    run = len(before) - len(before.rstrip(b"\\"))
    plain = np.where(data != 92, np.arange(len(data)), -1 - run)
    plain = np.concatenate([[-1 - run], np.maximum.accumulate(plain)])  # the last byte before each place that is no backslash
    at = np.flatnonzero(data == 34)
    return at[(at - 1 - plain[at]) % 2 == 0]


def _braces(data: np.ndarray, quotes: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places outside strings of ``[ { ] } ,`` and the bytes there."""
    at = np.flatnonzero((data == 91) | (data == 123) | (data == 93) | (data == 125) | (data == 44))
    outside = (np.searchsorted(quotes, at) + inside) % 2 == 0
    return at[outside], data[at[outside]]


def _steps(kinds: np.ndarray) -> np.ndarray:
    return np.where((kinds == 91) | (kinds == 123), 1, np.where(kinds == 44, 0, -1))


def _backslashes(f, start: int) -> bytes:
    """The run of backslashes before a place, with one byte more where there is one."""
    size = 64
    while True:
        begin = max(0, start - size)
        before = f.read_at(start - begin, begin)
        if begin == 0 or before.strip(b"\\"):
            return before
        size *= 16


def _key_before(f, at: int) -> str | None:
    """The key whose value begins at ``at``."""
    import json

    size = 256
    while True:
        begin = max(0, at - size)
        before = f.read_at(at - begin, begin)
        found = re.search(rb'(?<!\\)(?:\\\\)*("(?:[^"\\]|\\.)*")\s*:\s*$', before)
        if found or begin == 0 or size > 1 << 20:
            return json.loads(found[1]) if found else None
        size *= 16


def json_elements(spark: SparkSession, path: str, field: str | None = None, range_bytes: int = RANGE) -> DataFrame:
    """(at, value): the elements of the array ``field`` of a JSON document's outermost object, or of the outermost array, as text.

    ``at`` is an element's place in the file.  Two passes over ranges of the file, a task each, find out where elements begin, and a third reads
    them: the first asks what a range does to a reader that is inside or outside a string, the second counts depth from the state that
    follows.  Where a key occurs twice its last array counts; a document without the array has no elements.  An element is in one task, whole.
    """
    with _file(path) as f:
        size = f.size()
    n = max(1, -(-size // range_bytes))

    def each(read):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with _file(path) as f:
                for batch in batches:
                    for i in batch.column("id").to_pylist():
                        start = i * range_bytes
                        data = np.frombuffer(f.read_at(min(range_bytes, size - start), start), np.uint8)
                        yield from read(f, i, start, data, _quotes(data, _backslashes(f, start)))

        return run

    ranges = spark.range(0, n, 1, n)

    def state(f, i, start, data, quotes):
        steps = [int(_steps(_braces(data, quotes, inside)[1]).sum()) for inside in (False, True)]
        yield pa.RecordBatch.from_pydict({"i": [i], "odd": [len(quotes) % 2], "out": [steps[0]], "in": [steps[1]]})

    inside, depth, states = False, 0, {}
    told = {r[0]: r[1:] for r in ranges.mapInArrow(each(state), "i long, odd long, out long, in long").collect()}
    for i in range(n):
        states[i] = (inside, depth)
        odd, *steps = told[i]
        depth, inside = depth + steps[inside], inside ^ bool(odd)
    level = 1 if field is None else 2

    def bounds(f, i, start, data, quotes):
        """The first comma between elements, the last opening of the array, the first end of an array after either."""
        at, kinds = _braces(data, quotes, states[i][0])
        after = states[i][1] + np.cumsum(_steps(kinds))
        opens = [int(p) for p in at[(kinds == 91) & (after == level)] if field is None or _key_before(f, start + int(p)) == field]
        commas, ends = at[(kinds == 44) & (after == level)], at[(kinds == 93) & (after == level - 1)]
        first = lambda places: int(places[0]) + start if len(places) else None
        opened = opens[-1] if opens else None
        row = {"i": i, "comma": first(commas), "end": first(ends), "open": None if opened is None else opened + start, "close": None if opened is None else first(ends[ends > opened])}
        yield pa.RecordBatch.from_pylist([row], pa.schema([(c, pa.int64()) for c in row]))

    rows = sorted(ranges.mapInArrow(each(bounds), "i long, comma long, end long, open long, close long").collect())
    begin = max((r.open for r in rows if r.open is not None), default=None)
    cuts = []
    if begin is not None:
        opened = begin // range_bytes
        close = rows[opened].close
        for r in rows[opened + 1 :] if close is None else []:
            if r.comma is not None and (r.end is None or r.comma < r.end):
                cuts.append(r.comma)
            if (close := r.end) is not None:
                break
        cuts = [begin, *cuts, size if close is None else close]

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _file(path) as f:
            for batch in batches:
                for i in batch.column("id").to_pylist():
                    start, end = cuts[i] + 1, cuts[i + 1]
                    raw = f.read_at(end - start, start)
                    data = np.frombuffer(raw, np.uint8)
                    at, kinds = _braces(data, _quotes(data, b""), False)
                    split = at[(kinds == 44) & (np.cumsum(_steps(kinds)) == 0)]
                    edges = [-1, *split.tolist(), len(raw)]
                    found = [(start + a + 1, text) for a, b in zip(edges[:-1], edges[1:], strict=True) if (text := raw[a + 1 : b].strip().decode())]
                    for k in range(0, len(found), 4096):
                        part = found[k : k + 4096]
                        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in part], pa.int64()), pa.array([t for _, t in part], pa.string())], ["at", "value"])

    parts = len(cuts) - 1
    return spark.range(0, max(0, parts), 1, max(1, parts)).mapInArrow(elements, "at long, value string")


def json_array(spark: SparkSession, path: str, field: str | None, schema: str, range_bytes: int = RANGE) -> DataFrame:
    """The elements as columns of ``schema``; one that is no object has nulls."""
    return json_elements(spark, path, field, range_bytes).select(F.from_json("value", schema).alias("x")).select("x.*")


def annotated_boxes(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """Boxes of a document with images, annotations and categories of any size, joined on their ids."""
    images = json_array(spark, path, "images", "id long, width double, height double, file_name string", range_bytes).withColumnRenamed("id", "image_id")
    names = json_array(spark, path, "categories", "id long, name string, supercategory string", range_bytes).withColumnRenamed("id", "category_id")
    boxes = json_array(spark, path, "annotations", "image_id long, category_id long, bbox array<double>, area double, iscrowd int", range_bytes)
    told = boxes.join(images, "image_id").join(names, "category_id")
    crowd = F.coalesce(F.col("iscrowd") == 1, F.lit(False))
    return told.select("image_id", "name", "supercategory", *[F.col("bbox")[i].alias(c) for i, c in enumerate(("x", "y", "w", "h"))], "width", "height", crowd.alias("iscrowd"), "area", "file_name")


def tar_index(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(shard, at, member, offset, size) of the files in uncompressed tar files: headers are read, contents passed over.

    A task reads the headers of a shard.  A compressed shard, or a member stored with holes, cannot be read by ranges and is an error;
    ``readers.tar_members`` streams those.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.string()), ("at", pa.int64()), ("member", pa.string()), ("offset", pa.int64()), ("size", pa.int64())])
        for batch in batches:
            for shard in (paths[i] for i in batch.column("id").to_pylist()):
                rows = []
                with _file(shard) as f, tarfile.open(fileobj=f, mode="r:") as tar:
                    for at, m in enumerate(tar):
                        if m.issparse():
                            raise ValueError(f"{m.name} in {shard} is stored with holes")
                        if m.isfile():
                            rows.append({"shard": shard, "at": at, "member": m.name, "offset": m.offset_data, "size": m.size})
                        tar.members = []  # a list of all members would grow with the shard
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.range(0, len(paths), 1, max(1, len(paths))).mapInArrow(run, "shard string, at long, member string, offset long, size long")


def members_by_range(index: DataFrame, tasks: int, batch_bytes: int = 32 << 20) -> DataFrame:
    """(shard, at, member, data): the members of an index, whole or filtered, dealt to ``tasks`` by place, so several read one shard.

    A batch holds about ``batch_bytes``, one member at least; a member that no cell can hold (2 GB) is an error.
    """
    schema = pa.schema([("shard", pa.string()), ("at", pa.int64()), ("member", pa.string()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f, rows, held = None, None, [], 0
        try:
            for row in (r for b in batches for r in b.to_pylist()):
                if row["size"] >= 1 << 31:
                    raise ValueError(f"{row['member']} in {row['shard']} has {row['size']} bytes, more than a cell holds")
                if rows and held + row["size"] > batch_bytes:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
                if row["shard"] != name:
                    if f is not None:
                        f.close()
                    name, f = row["shard"], _file(row["shard"])
                data = f.read_at(row["size"], row["offset"]) if row["size"] else b""
                if len(data) != row["size"]:
                    raise ValueError(f"{row['member']} in {row['shard']} is cut short")
                rows.append({"shard": name, "at": row["at"], "member": row["member"], "data": data})
                held += row["size"]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)
        finally:
            if f is not None:
                f.close()

    dealt = index.repartitionByRange(tasks, "shard", "at").sortWithinPartitions("shard", "at")
    return dealt.mapInArrow(run, "shard string, at long, member string, data binary")
