"""Reading one large JSON document with many tasks: a Python data source over byte ranges.

Whether a byte lies in a string, and how deep it is nested, depends on all bytes before it.  But what a range does to that
state is a small function: for each of the three states it may begin in (outside, in a string, behind a backslash) the state it
ends in and by how much the depth changes, and such functions compose.  A first job finds them for all ranges, the driver composes them, one
step per range, and a second job reads every range from its true state and cuts out the parts that
begin in it, reading on to the end of the last one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES = 32 << 20
KEY_BYTES = 4096            # a top-level key is at most as long
OUTSIDE, IN_STRING, ESCAPED = 0, 1, 2
QUOTE, BACKSLASH, COLON = ord('"'), ord("\\"), ord(":")
STEP = np.zeros(256, np.int64)
STEP[[ord("{"), ord("[")]], STEP[[ord("}"), ord("]")]] = 1, -1


def _open(path: str):
    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return system.open_input_file(inner)


def _bytes(path: str, start: int, size: int) -> bytes:
    with _open(path) as f:
        return f.read_at(min(size, max(0, f.size() - start)), start)


def _quotes(data: np.ndarray, state: int) -> tuple[np.ndarray, bool]:
    """Places of the quotes that are not behind an odd run of backslashes, and whether the data ends behind one."""
    slash = data == BACKSLASH
    if state == ESCAPED and len(data):
        slash[0] = False                    # the first byte is spent
    at = np.arange(len(data))
    last_other = np.maximum.accumulate(np.where(slash, -1, at)) if len(data) else at
    run = at - last_other                   # backslashes up to and including each place
    quotes = np.flatnonzero(data == QUOTE)
    before = np.where(quotes > 0, run[np.maximum(quotes - 1, 0)], 0)
    real = before % 2 == 0
    if state == ESCAPED:
        real &= quotes > 0
    return quotes[real], bool(len(data) and run[-1] % 2)


def scan(data: bytes, state: int, size: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(real quotes, depth after every byte relative to the start, end state, change of depth) of the first `size` bytes; the
    quotes of the bytes behind them are there as well."""
    raw = np.frombuffer(data, np.uint8)
    quotes, _ = _quotes(raw, state)
    inside = np.zeros(len(raw) + 1, np.int64)
    inside[quotes + 1] = 1
    inside = (np.cumsum(inside) + (state != OUTSIDE)) % 2
    depth = np.cumsum(np.where(inside[:-1] == 0, STEP[raw], 0))
    if not size:
        return quotes, depth, state, 0
    _, escaped = _quotes(raw[:size], state)
    within = inside[size]
    return quotes, depth, (ESCAPED if within and escaped else IN_STRING if within else OUTSIDE), int(depth[size - 1])


def keys_in(data: bytes, quotes: np.ndarray, depth: np.ndarray, state: int, size: int, deepest: int) -> list[tuple[int, int, str]]:
    """(place, relative depth, key) of the strings that begin in the first `size` bytes, no deeper than `deepest`, and are followed by a colon."""
    openings = quotes[(0 if state == OUTSIDE else 1)::2]
    closings = quotes[(1 if state == OUTSIDE else 2)::2]
    openings = openings[:len(closings)]
    wanted = (openings < size) & (closings - openings <= KEY_BYTES)
    openings, closings = openings[wanted], closings[wanted]
    wanted = depth[openings] <= deepest         # most strings lie deeper, and are not looked at one by one
    out = []
    for a, b in zip(openings[wanted].tolist(), closings[wanted].tolist()):
        if data[b + 1:b + 65].lstrip()[:1] == b":":
            try:
                out.append((a, int(depth[a]), json.loads(data[a:b + 1])))
            except ValueError:
                continue
    return out


def summary(data: bytes, size: int, states: Sequence[int] = (OUTSIDE, IN_STRING, ESCAPED)) -> list[dict]:
    """For each state a range may begin in: the end state, the change of depth, its least value, and per relative depth the keys, in order."""
    out = []
    for state in states:
        quotes, depth, end, change = scan(data, state, size)
        least = int(depth[:size].min(initial=0))
        keys: dict[int, list[str]] = {}
        for _, d, key in keys_in(data, quotes, depth, state, size, max(1, least + 1)):    # the whole document's keys can't be deeper
            held = keys.setdefault(d, [])
            if key in held:
                held.remove(key)
            held.append(key)
        out.append({"end": end, "change": change, "least": least, "keys": {str(k): v for k, v in keys.items()}})
    return out


@dataclass
class Range:
    path: str
    start: int
    size: int
    state: int = OUTSIDE
    depth: int = 0
    key: str | None = None


@dataclass
class Ranges(InputPartition):
    """What one task reads: a range, or several of small documents."""
    ranges: list[Range]


def packed(ranges: list[Range], most: int) -> list[Ranges]:
    """Consecutive ranges of `most` bytes together at most; a larger range stands alone."""
    out, held = [], most
    for r in ranges:
        if held + r.size > most:
            out.append(Ranges([]))
            held = 0
        out[-1].ranges.append(r)
        held += r.size
    return out


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.ranges = [Range(**r) for r in json.loads(options["ranges"])]
        self.most = int(options["most"])
        self.items, self.values = (set(json.loads(options.get(k, "[]"))) for k in ("items", "values"))

    def partitions(self) -> Sequence[InputPartition]:
        return packed(self.ranges, self.most)

    def __getstate__(self) -> dict:
        return {**vars(self), "ranges": []}         # the reader goes to every task, a range only to its own

    def read(self, part: Ranges) -> Iterator:
        for r in part.ranges:
            yield from self.read_range(r)


class _Summaries(_Reader):
    def read_range(self, part: Range) -> Iterator[tuple]:
        data = _bytes(part.path, part.start, part.size + KEY_BYTES + 64)
        states = (OUTSIDE, IN_STRING, ESCAPED) if part.start else (OUTSIDE,)        # a document begins outside
        yield part.path, part.start, json.dumps(summary(data, min(part.size, len(data)), states))


class _Parts(_Reader):
    def read_range(self, part: Range) -> Iterator[pa.RecordBatch]:
        data, more = _bytes(part.path, part.start, part.size + KEY_BYTES + 64), KEY_BYTES
        size = min(part.size, len(data))
        quotes, depth, _, _ = scan(data, part.state, size)
        keys = [(a, k) for a, d, k in keys_in(data, quotes, depth, part.state, size, 1 - part.depth) if d + part.depth == 1]
        raw = np.frombuffer(data, np.uint8)
        change = np.diff(np.concatenate(([0], depth)))
        begins = np.flatnonzero((change[:size] == 1) & (raw[:size] == ord("{")))
        level = depth[begins] + part.depth
        begins, level = begins[(level == 2) | (level == 3)], level[(level == 2) | (level == 3)]
        places = [a for a, _ in keys]
        rows: list[tuple] = []

        def closings(depth):        # a part ends where the depth first falls below its own
            falls = np.diff(depth, prepend=0) == -1
            return {deep: np.flatnonzero(falls & (depth == deep - 1 - part.depth)) for deep in (2, 3)}

        ends = closings(depth)
        for at, deep in zip(begins.tolist(), level.tolist()):
            k = int(np.searchsorted(places, at)) - 1
            key = keys[k][1] if k >= 0 else part.key
            if not (deep == 3 and key in self.items or deep == 2 and key in self.values):
                continue
            while True:         # on to the end of the part, which may lie in later ranges
                end = int(np.searchsorted(ends[deep], at))
                if end < len(ends[deep]):
                    break
                longer = _bytes(part.path, part.start, len(data) + more)
                if len(longer) == len(data):
                    break
                data, more = longer, more * 2
                _, depth, _, _ = scan(data, part.state, size)
                ends = closings(depth)
            if end < len(ends[deep]):
                rows.append((part.path, part.start + at, key, data[at:int(ends[deep][end]) + 1].decode("utf-8", "replace")))
            if len(rows) >= 1000:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()),
                                           pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string())], names=["path", "place", "key", "value"])


class JsonSummaries(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_summaries"

    def schema(self) -> str:
        return "path string, start long, summary string"

    def reader(self, schema) -> DataSourceReader:
        return _Summaries(self.options)


class JsonParts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_parts"

    def schema(self) -> str:
        return "path string, place long, key string, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Parts(self.options)


def files_of(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the files in a folder that are no markers."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(root) or []
    out = []
    for status in found:
        listed = status.getPath().getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(status.getPath())
        for f in listed:
            name, size = f.getPath().toString(), f.getLen()
            if name.rpartition("/")[2][0] not in "._" and f.isFile():
                out.append((name, size))
    return sorted(out)


def _packing(spark: SparkSession, ranges: list[Range], range_bytes: int) -> int:
    """Bytes for a task: every core gets some, and a task no more than a range has."""
    return max(1, min(range_bytes, max(1 << 20, sum(r.size for r in ranges) // (2 * spark.sparkContext.defaultParallelism))))


def _listed(ranges: list[Range]) -> str:
    return json.dumps([vars(r) for r in ranges])


def whole_documents(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> tuple[list[Range], dict[str, set[str]]]:
    """The ranges of the documents that close what they open, each with the state it begins in, and these documents' top-level keys."""
    for source in (JsonSummaries, JsonParts):
        spark.dataSource.register(source)
    ranges = [Range(p, a, min(range_bytes, n - a)) for p, n in files_of(spark, path) for a in range(0, n, range_bytes)]
    found = {}
    if ranges:
        summaries = spark.read.format("json_summaries").option("ranges", _listed(ranges)).option("most", _packing(spark, ranges, range_bytes)).load()
        for r in summaries.collect():     # a few values per range
            found[r.path, r.start] = json.loads(r.summary)
    whole: dict[str, set[str]] = {}
    state, depth, key, seen, ok = OUTSIDE, 0, None, set(), True
    for i, r in enumerate(ranges):
        if r.start == 0:
            state, depth, key, seen, ok = OUTSIDE, 0, None, set(), True
        r.state, r.depth, r.key = state, depth, key
        does = found[r.path, r.start][state]
        ok &= depth + does["least"] >= 0
        top = does["keys"].get(str(1 - depth), [])
        seen.update(top)
        state, depth, key = does["end"], depth + does["change"], top[-1] if top else key
        if i + 1 == len(ranges) or ranges[i + 1].path != r.path:
            if ok and state == OUTSIDE and depth == 0 and seen:
                whole[r.path] = seen
    return [r for r in ranges if r.path in whole], whole


def parts_of(spark: SparkSession, ranges: list[Range], items: Sequence[str] = (), values: Sequence[str] = (),
             range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, place, key, value) per part in the given ranges of whole documents."""
    return (spark.read.format("json_parts").option("ranges", _listed(ranges)).option("most", _packing(spark, ranges, range_bytes))
            .option("items", json.dumps(list(items))).option("values", json.dumps(list(values))).load())


def json_parts(spark: SparkSession, path: str, items: Sequence[str] = (), values: Sequence[str] = (),
               range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, dict[str, set[str]]]:
    """(path, place, key, value) per part of the JSON documents at a path, and the top-level keys of every whole document.

    Parts are the objects in the arrays under the top-level keys `items`, and the objects under the top-level keys `values`, as text with the
    byte they begin at.  A file holds one document; small documents share a task.  A document that does not close what it opens gives no
    parts and no keys.  The path must be one that `pyarrow.fs` can open; the driver holds one state per range.
    """
    ranges, whole = whole_documents(spark, path, range_bytes)
    return parts_of(spark, ranges, items, values, range_bytes), whole
