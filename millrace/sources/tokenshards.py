"""Token shards.

Two forms:

* Parquet ``(split, shard, pos, doc_id, tokens ARRAY<INT>)`` partitioned by
  split and shard, with the token width kept as a column;
* the raw layout ``{split}/{split}_{shard:06d}.bin`` (little endian
  uint16/uint32, documents concatenated, no header) through a Python
  ``DataSource``. Rows are hash-partitioned by (split, shard) and sorted by
  position, so each task streams whole shards in order, as Arrow batches. A
  task writes below ``_attempt/<its own folder>`` and, when a file is whole,
  moves it to the job's folder ``_job/<job>/<split>``; another attempt at the
  task writes the same bytes there. Overwriting, the driver's commit puts one
  folder per split into place; appending, it moves the files to those that are
  there. The reader takes ranges of a file and yields Arrow batches.

Paths go through ``pyarrow.fs`` (a local or mounted folder, HDFS, S3, ...).
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

CHUNK = 1 << 16                 # tokens per row
RANGE = 64 * CHUNK              # tokens per reading task


def _fs(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def _shard_files(filesystem, root: str) -> list[tuple[str, int, str, int]]:
    """``(split, shard, path, bytes)`` of the shards in place, in order."""
    from pyarrow import fs
    out = []
    for f in filesystem.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        split, _, name = f.path[len(root):].strip("/").rpartition("/")
        if f.type == fs.FileType.File and (m := re.fullmatch(re.escape(split) + r"_(\d+)\.bin", name)) and split and not split.startswith("_"):
            out.append((split, int(m[1]), f.path, f.size))
    return sorted(out)


class _Range(InputPartition):
    def __init__(self, split: str, shard: int, path: str, start: int, count: int):
        self.split, self.shard, self.path, self.start, self.count = split, shard, path, start, count


class _Commit(WriterCommitMessage):
    def __init__(self, splits: list[str]):
        self.splits = splits


class _Shards:
    def __init__(self, options):
        self.uri = options["path"]
        self.dtype = np.dtype(options.get("dtype", "uint16")).newbyteorder("<")


class TokenShardReader(_Shards, DataSourceReader):
    def partitions(self):
        filesystem, root = _fs(self.uri)
        parts = []
        for split, shard, path, size in _shard_files(filesystem, root):
            n = size // self.dtype.itemsize
            parts += [_Range(split, shard, path, k, min(RANGE, n - k)) for k in range(0, n, RANGE)]
        return parts or [None]          # no shards: one task without rows

    def read(self, partition):
        if partition is None:
            return
        filesystem, _ = _fs(self.uri)
        with filesystem.open_input_file(partition.path) as f:
            raw = f.read_at(partition.count * self.dtype.itemsize, partition.start * self.dtype.itemsize)
        tokens = np.frombuffer(raw, self.dtype).astype(np.int64)
        offsets = np.r_[np.arange(0, len(tokens), CHUNK), len(tokens)].astype(np.int32)
        n = len(offsets) - 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([partition.split] * n), pa.array(np.full(n, partition.shard, np.int32)),
             pa.array((partition.start // CHUNK + np.arange(n)).astype(np.int32)),
             pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens))],
            names=["split", "shard", "chunk", "tokens"])


class TokenShardWriter(_Shards, DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        super().__init__(options)
        self.overwrite, self.job = overwrite, uuid.uuid4().hex

    def write(self, iterator):
        filesystem, root = _fs(self.uri)
        attempt, staged = f"{root}/_attempt/{uuid.uuid4().hex}", f"{root}/_job/{self.job}"
        splits, handle, current = set(), None, None

        def close():
            if handle:
                handle.close()
                split, shard = current
                filesystem.create_dir(f"{staged}/{split}")
                filesystem.move(f"{attempt}/{split}_{shard}", f"{staged}/{split}/{split}_{shard:06d}.bin")

        for batch in iterator:               # sorted by split, shard, pos within the task
            split = batch.column("split").to_numpy(zero_copy_only=False)
            shard = batch.column("shard").to_numpy(zero_copy_only=False)
            tokens = batch.column("tokens")
            cuts = np.flatnonzero(np.r_[True, (split[1:] != split[:-1]) | (shard[1:] != shard[:-1]), True]).tolist() if len(split) else []
            for a, b in zip(cuts, cuts[1:]):
                key = (split[a], int(shard[a]))
                if key != current:
                    close()
                    filesystem.create_dir(attempt)
                    handle, current = filesystem.open_output_stream(f"{attempt}/{key[0]}_{key[1]}"), key
                    splits.add(key[0])
                handle.write(tokens.slice(a, b - a).flatten().to_numpy(zero_copy_only=False).astype(self.dtype).tobytes())
        close()
        return _Commit(sorted(splits))

    def commit(self, messages):
        from pyarrow import fs
        filesystem, root = _fs(self.uri)
        staged = f"{root}/_job/{self.job}"
        if self.overwrite:
            for split in sorted({s for s, *_ in _shard_files(filesystem, root)}):
                filesystem.delete_dir(f"{root}/{split}")
        for split in sorted({s for m in messages if m for s in m.splits}):
            if filesystem.get_file_info(f"{root}/{split}").type == fs.FileType.Directory:
                for f in filesystem.get_file_info(fs.FileSelector(f"{staged}/{split}")):
                    filesystem.move(f.path, f"{root}/{split}/{f.base_name}")
            else:
                filesystem.move(f"{staged}/{split}", f"{root}/{split}")
        self._drop(filesystem, root)

    def abort(self, messages):
        self._drop(*_fs(self.uri))

    @staticmethod
    def _drop(filesystem, root):
        from pyarrow import fs
        for name in ("_attempt", "_job"):
            if filesystem.get_file_info(f"{root}/{name}").type == fs.FileType.Directory:
                filesystem.delete_dir(f"{root}/{name}")


class TokenShards(DataSource):
    """``spark.read/write.format("tokenshards").option("path", ..).option("dtype", "uint16")``."""

    @classmethod
    def name(cls):
        return "tokenshards"

    def schema(self):
        return "split string, shard int, chunk int, tokens array<bigint>"

    def reader(self, schema):
        return TokenShardReader(self.options)

    def writer(self, schema, overwrite):
        return TokenShardWriter(self.options, overwrite)


def register(spark) -> None:
    spark.dataSource.register(TokenShards)


def write_raw_shards(df: DataFrame, path: str, dtype: str = "uint16") -> None:
    """Rows ``(split, shard, pos, tokens)`` -> ``.bin`` files; shards that were there before go."""
    register(df.sparkSession)
    (df.select("split", "shard", "pos", "tokens")
       .repartition("split", "shard").sortWithinPartitions("split", "shard", "pos")
       .write.format("tokenshards").option("path", path).option("dtype", dtype).mode("overwrite").save())


def read_raw_shards(spark, path: str, dtype: str = "uint16") -> DataFrame:
    register(spark)
    return spark.read.format("tokenshards").option("path", path).option("dtype", dtype).load()


def write_parquet_shards(df: DataFrame, path: str, dtype: str = "uint16") -> DataFrame:
    from pyspark.sql import functions as F
    out = df.select("split", "shard", "pos", "doc_id", "tokens").withColumn("dtype", F.lit(dtype))
    out.write.mode("overwrite").partitionBy("split", "shard").parquet(path)
    return df.sparkSession.read.parquet(path)
