"""An append-only audit table written by streams: a sink with a commit protocol, and a Bloom filter per file for replays.

    data/<file>.parquet      rows of one task of one micro-batch, with no key twice
    data/<file>.bloom        the filter of its keys
    commits/<writer>/<n>     the files of micro-batch n of a writer, one name per line; made at once, never changed

Only files that a commit names belong to the table.  A task that fails or is repeated leaves files without a commit, and a
micro-batch that is run again finds its commit and leaves its new files out.  Rows whose key the table holds already, from another
writer or an earlier micro-batch, are left out by the task: it tests its keys against the filters of the committed files, one
filter at a time, and opens only the files whose filter hits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

BITS_PER_KEY, PROBES = 12, 8


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _hashes(keys: list) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(str(k)) for k in keys], np.uint64)


def _probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return (hashes[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(bits)


def bloom(hashes: np.ndarray) -> np.ndarray:
    """A filter with about `BITS_PER_KEY` bits per key: one key in 300 that is not in it seems to be."""
    bits = max(64, -(-len(hashes) * BITS_PER_KEY // 8) * 8)
    held = np.zeros(bits, bool)
    held[_probes(hashes, bits).ravel()] = True
    return np.packbits(held, bitorder="little")


def maybe_in(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = _probes(hashes, len(filter_) * 8)
    return ((filter_[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def committed(path: str) -> list[str]:
    """The table's files, without ending."""
    system, root = filesystem(path)
    if system.get_file_info(f"{root}/commits").type == fs.FileType.NotFound:
        return []
    commits = [f for f in system.get_file_info(fs.FileSelector(f"{root}/commits", recursive=True)) if f.is_file and not f.base_name.startswith(".")]
    names = []
    for f in sorted(commits, key=lambda f: f.path):
        with system.open_input_file(f.path) as stream:
            names += stream.read().decode().split()
    return names


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    rows: int
    opened: int


class AuditWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str, key: str, writer: str, schema: StructType):
        self.path, self.key, self.writer, self.schema = path, key, writer, schema

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        """The task's rows in one file; a task holds the rows of its part of a micro-batch that are new."""
        system, root = filesystem(self.path)
        held = [b for b in batches if b.num_rows]
        if not held:
            return Written(None, 0, 0)
        table = pa.Table.from_batches(held)
        keys = table.column(self.key).to_pylist()
        first = {k: i for i, k in reversed(list(enumerate(keys)))}          # of one key in a task the first row stays
        keep = np.array(sorted(first.values()))
        hashes, opened = _hashes([keys[i] for i in keep]), 0
        new = np.ones(len(keep), bool)
        for name in committed(self.path):
            with system.open_input_file(f"{root}/data/{name}.bloom") as stream:
                hit = new & maybe_in(np.frombuffer(stream.read(), np.uint8), hashes)
            if hit.any():
                opened += 1
                there = set(pq.read_table(f"{root}/data/{name}.parquet", columns=[self.key], filesystem=system).column(0).to_pylist())
                for i in np.flatnonzero(hit):
                    new[i] = keys[keep[i]] not in there
        keep, hashes = keep[new], hashes[new]
        if not len(keep):
            return Written(None, 0, opened)
        name = uuid.uuid4().hex
        system.create_dir(f"{root}/data", recursive=True)
        pq.write_table(table.take(pa.array(keep)), f"{root}/data/{name}.parquet", filesystem=system)
        with system.open_output_stream(f"{root}/data/{name}.bloom") as stream:
            stream.write(bloom(hashes).tobytes())
        return Written(name, len(keep), opened)

    def _delete(self, messages) -> None:
        system, root = filesystem(self.path)
        for m in messages:
            if m is not None and m.file:
                for ending in ("parquet", "bloom"):
                    system.delete_file(f"{root}/data/{m.file}.{ending}")

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        system, root = filesystem(self.path)
        folder, target = f"{root}/commits/{self.writer}", f"{root}/commits/{self.writer}/{batchId}"
        if system.get_file_info(target).type != fs.FileType.NotFound:       # the micro-batch is run again
            self._delete(messages)
            return
        system.create_dir(folder, recursive=True)
        temporary = f"{folder}/.{batchId}-{uuid.uuid4().hex}"
        with system.open_output_stream(temporary) as stream:
            stream.write("\n".join(m.file for m in messages if m is not None and m.file).encode())
        system.move(temporary, target)

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        self._delete(messages)


class AuditTable(DataSource):
    """Options: path, key (a column that names a row), writer (one name per stream, kept over restarts)."""

    @classmethod
    def name(cls) -> str:
        return "audit_table"

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return AuditWriter(self.options["path"], self.options["key"], self.options["writer"], schema)


def append_to_audit(rows: DataFrame, path: str, key: str, writer: str, checkpoint: str, **trigger) -> StreamingQuery:
    """A stream's rows into the audit table at `path`, each key once.

    `writer` names the stream's commits; another stream with the same rows adds nothing.  Keys are compared within a micro-batch by
    task, so rows are dealt by key first.  Two streams that run at the same time do not see each other's last micro-batch.
    """
    rows.sparkSession.dataSource.register(AuditTable)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows.repartition(n, key).writeStream.format("audit_table").option("path", path).option("key", key).option("writer", writer)
            .option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start())


def read_audit(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The committed rows of an audit table."""
    names = committed(path)
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/data/{n}.parquet" for n in names])
