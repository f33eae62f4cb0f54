"""``.npy`` shards as rows ``(id, embedding)`` through a Python data source.

The driver reads only the headers.  Each shard is cut into row ranges, and every task reads the
bytes of its own range, so a shard of any size is read in parallel.  Ids follow the sorted shard
paths.  Paths may carry any scheme pyarrow knows (local, hdfs, s3, gs).  Shards are written as a stream too.
"""

from __future__ import annotations

import fnmatch
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib import format as npy_format
from pyarrow import fs as pa_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

# Rows handed to Spark at a time inside a task.
ROWS_PER_BATCH = 10_000
DEFAULT_PARTITION_BYTES = 128 * 1024 * 1024
COPY_BYTES = 8 * 1024 * 1024


@dataclass
class Shard:
    path: str
    rows: int
    dim: int
    dtype: str
    data_offset: int
    column_major: bool


@dataclass
class StagedShard(WriterCommitMessage):
    location: str | None  # without rows there is no file
    partition: int
    dim: int


@dataclass
class RowRange(InputPartition):
    shard: Shard
    start: int
    count: int
    first_id: int


def _open_location(path: str):
    if "://" in path:
        return pa_fs.FileSystem.from_uri(path)
    return pa_fs.LocalFileSystem(), path.removeprefix("file:")


def list_shards(pattern: str) -> list[str]:
    """Paths matching a glob in the last path component, sorted."""
    filesystem, location = _open_location(pattern)
    folder, _, name = location.rpartition("/")
    entries = filesystem.get_file_info(pa_fs.FileSelector(folder or ".", allow_not_found=True))
    prefix = pattern[: len(pattern) - len(location)] if "://" in pattern else ""
    return sorted(
        prefix + e.path for e in entries if e.type == pa_fs.FileType.File and fnmatch.fnmatch(e.base_name, name)
    )


def read_header(path: str) -> Shard:
    filesystem, location = _open_location(path)
    with filesystem.open_input_file(location) as handle:
        version = npy_format.read_magic(handle)
        read = npy_format.read_array_header_1_0 if version == (1, 0) else npy_format.read_array_header_2_0
        shape, column_major, dtype = read(handle)
        if len(shape) != 2:
            raise ValueError(f"{path}: expected a 2-D array, found shape {shape}")
        if dtype.kind not in "fiu":
            raise ValueError(f"{path}: expected numbers, found {dtype}")
        return Shard(path, shape[0], shape[1], dtype.str, handle.tell(), column_major)


def read_rows(shard: Shard, start: int, count: int) -> np.ndarray:
    """Rows ``start .. start+count`` of one shard as float32."""
    dtype = np.dtype(shard.dtype)
    filesystem, location = _open_location(shard.path)
    with filesystem.open_input_file(location) as handle:
        if not shard.column_major:
            handle.seek(shard.data_offset + start * shard.dim * dtype.itemsize)
            raw = handle.read(count * shard.dim * dtype.itemsize)
            return np.frombuffer(raw, dtype=dtype).reshape(count, shard.dim).astype(np.float32)
        block = np.empty((count, shard.dim), dtype=np.float32)
        for column in range(shard.dim):
            handle.seek(shard.data_offset + (column * shard.rows + start) * dtype.itemsize)
            block[:, column] = np.frombuffer(handle.read(count * dtype.itemsize), dtype=dtype)
        return block


class NpyReader(DataSourceReader):
    def __init__(self, options):
        self.pattern = options["path"]
        self.partition_bytes = int(options.get("partitionBytes", DEFAULT_PARTITION_BYTES))

    def partitions(self) -> list[RowRange]:
        paths = list_shards(self.pattern)
        if not paths:
            raise ValueError(f"no .npy file matches {self.pattern}")
        shards = [read_header(path) for path in paths]
        widths = {shard.dim for shard in shards}
        if len(widths) > 1:
            raise ValueError(f"vector widths differ between shards: {sorted(widths)}")
        ranges, first_id = [], 0
        for shard in shards:
            row_bytes = max(1, shard.dim * np.dtype(shard.dtype).itemsize)
            step = max(1, self.partition_bytes // row_bytes)
            for start in range(0, shard.rows, step):
                count = min(step, shard.rows - start)
                ranges.append(RowRange(shard, start, count, first_id + start))
            first_id += shard.rows
        return ranges

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        shard = partition.shard
        for done in range(0, partition.count, ROWS_PER_BATCH):
            count = min(ROWS_PER_BATCH, partition.count - done)
            block = read_rows(shard, partition.start + done, count)
            ids = np.arange(count, dtype=np.int64) + partition.first_id + done
            offsets = np.arange(count + 1, dtype=np.int32) * shard.dim
            vectors = pa.ListArray.from_arrays(pa.array(offsets), pa.array(block.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(ids), vectors], names=["id", "embedding"])


def _float32_rows(batch: pa.RecordBatch, dim: int | None) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("embedding"))
    if column.null_count or column.flatten().null_count:
        raise ValueError("a vector, or a number in one, is null")
    widths = pc.unique(pc.list_value_length(column)).to_pylist()
    if len(widths) > 1 or dim not in (None, widths[0]):
        raise ValueError(f"vector widths differ: {sorted({*widths, *([] if dim is None else [dim])})}")
    return column.flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(len(column), -1)


class NpyWriter(DataSourceArrowWriter):
    """Each task streams its rows to a file of its own below a staging folder; the commit gives the files their names.

    The header holds the number of rows, known only at the end, and object stores cannot go back to write it. So rows
    go to a body first, and header and body are then joined, a block at a time.
    """

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.staging = f"_staging-{uuid.uuid4().hex}"
        if not overwrite and list_shards(f"{self.path}/*.npy"):
            raise ValueError(f"{self.path} holds .npy files already")

    def write(self, batches: Iterator[pa.RecordBatch]) -> StagedShard:
        context = TaskContext.get()
        filesystem, location = _open_location(self.path)
        filesystem.create_dir(f"{location}/{self.staging}")
        # the attempt is part of the name, so that a speculative copy of the task writes files of its own
        staged = f"{location}/{self.staging}/{context.partitionId()}-{context.taskAttemptId()}"
        rows, dim = 0, None
        with filesystem.open_output_stream(f"{staged}.body") as body:
            for batch in batches:
                if batch.num_rows:
                    block = _float32_rows(batch, dim)
                    rows, dim = rows + len(block), block.shape[1]
                    body.write(block.data)
        if dim is None:
            return StagedShard(None, context.partitionId(), 0)
        with filesystem.open_output_stream(f"{staged}.npy") as handle, filesystem.open_input_stream(f"{staged}.body") as body:
            npy_format.write_array_header_1_0(handle, {"descr": "<f4", "fortran_order": False, "shape": (rows, dim)})
            while block := body.read(COPY_BYTES):
                handle.write(block)
        filesystem.delete_file(f"{staged}.body")
        return StagedShard(f"{staged}.npy", context.partitionId(), dim)

    def commit(self, messages: list[StagedShard | None]) -> None:
        filesystem, location = _open_location(self.path)
        staged = [m for m in messages if m is not None and m.location is not None]
        widths = {m.dim for m in staged}
        if len(widths) > 1:
            self.abort(messages)
            raise ValueError(f"vector widths differ between shards: {sorted(widths)}")
        if self.overwrite:
            for old in list_shards(f"{self.path}/*.npy"):
                filesystem.delete_file(_open_location(old)[1])
        for message in staged:
            filesystem.move(message.location, f"{location}/part_{message.partition:06d}.npy")
        self._clear()

    def abort(self, messages: list[StagedShard | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        filesystem, location = _open_location(self.path)
        if filesystem.get_file_info(f"{location}/{self.staging}").type == pa_fs.FileType.Directory:
            filesystem.delete_dir(f"{location}/{self.staging}")


class NpyDataSource(DataSource):
    """``spark.read.format("npy").load("dir/text_emb_*.npy")``, ``emb.write.format("npy").mode("append").save("dir")``"""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "id bigint, embedding array<float>"

    def reader(self, schema) -> DataSourceReader:
        return NpyReader(self.options)

    def writer(self, schema, overwrite: bool) -> NpyWriter:
        return NpyWriter(self.options, overwrite)


def read_npy(spark: SparkSession, pattern: str, partition_bytes: int = DEFAULT_PARTITION_BYTES) -> DataFrame:
    """All shards matching a glob, with contiguous ids over the sorted shard paths."""
    spark.dataSource.register(NpyDataSource)
    return spark.read.format("npy").option("partitionBytes", partition_bytes).load(pattern)


def write_npy(emb: DataFrame, path: str, shards: int, overwrite: bool = False) -> None:
    """Vectors ``(id, embedding)`` to float32 ``.npy`` shards in id order, one file per task.

    File names sort in id order, so reading them back gives contiguous ids in the same order. A task holds one
    batch. The files appear when all tasks have succeeded; a folder that has shards already is refused unless
    ``overwrite`` is set, which takes the old ones away then. No rows give no files; a null vector and
    vectors of several widths are errors.
    """
    emb.sparkSession.dataSource.register(NpyDataSource)
    ordered = emb.select("id", "embedding").repartitionByRange(shards, "id").sortWithinPartitions("id")
    ordered.write.format("npy").mode("overwrite" if overwrite else "append").save(path)
