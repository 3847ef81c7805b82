"""Audio samples as a Spark data source: ``spark.read.format("pulsegrid_samples")`` and ``readStream`` with the same rows.

Files hold little-endian float32 samples of one channel. A row is one chunk of ``chunk`` samples: path, stream_id (a hash of the
path), chunk_idx and samples; a trailing shorter chunk comes last in a batch and waits in a stream. What else lies in the folder, or
comes later, never changes a file's id.
"""

from __future__ import annotations

import glob
import hashlib
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "stream_id long, path string, chunk_idx long, samples array<float>"
_BYTES = 4


def stream_id(path: str) -> int:
    """63 bits of the path's SHA-256: the same in every query, batch or stream."""
    return int.from_bytes(hashlib.sha256(path.encode()).digest()[:8], "big") >> 1


class Chunks(InputPartition):
    """Chunks ``first`` to ``last`` (exclusive) of one file."""

    def __init__(self, stream_id: int, path: str, first: int, last: int):
        super().__init__(None)
        self.stream_id, self.path, self.first, self.last = stream_id, path, first, last


def _rows(part: Chunks, chunk: int) -> Iterator[tuple]:
    import numpy as np

    with open(part.path, "rb") as f:
        f.seek(part.first * chunk * _BYTES)
        for k in range(part.first, part.last):
            raw = f.read(chunk * _BYTES)
            raw = raw[: len(raw) // _BYTES * _BYTES]
            if raw:
                yield part.stream_id, part.path, k, np.frombuffer(raw, "<f4").tolist()


class SampleSource(DataSource):
    """Options: path (a glob of files on storage that all machines see), chunk (256), chunks_per_task (4096),
    max_chunks_per_trigger (for each file of a stream; 4096)."""

    @classmethod
    def name(cls) -> str:
        return "pulsegrid_samples"

    def schema(self) -> str:
        return SCHEMA

    def _number(self, name: str, default: int) -> int:
        value = int(self.options.get(name, default))
        if value < 1:
            raise ValueError(f"{name} must be positive")
        return value

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options["path"], self._number("chunk", 256), self._number("chunks_per_task", 4096))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["path"], self._number("chunk", 256), self._number("chunks_per_task", 4096), self._number("max_chunks_per_trigger", 4096))


class _Batch(DataSourceReader):
    def __init__(self, path: str, chunk: int, per_task: int):
        self.path, self.chunk, self.per_task = path, chunk, per_task

    def partitions(self) -> list[Chunks]:
        out = []
        for path in sorted(glob.glob(self.path)):
            n = -(-(os.path.getsize(path) // _BYTES) // self.chunk)
            out += [Chunks(stream_id(path), path, a, min(n, a + self.per_task)) for a in range(0, n, self.per_task)]
        return out

    def read(self, partition: Chunks) -> Iterator[tuple]:
        return _rows(partition, self.chunk)


class _Stream(DataSourceStreamReader):
    """Offsets are whole chunks read so far of each file; a trigger takes at most ``limit`` more of each."""

    def __init__(self, path: str, chunk: int, per_task: int, limit: int):
        self.path, self.chunk, self.per_task, self.limit = path, chunk, per_task, limit
        self.reached: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for path in sorted(glob.glob(self.path)):
            whole = os.path.getsize(path) // _BYTES // self.chunk
            self.reached[path] = min(whole, self.reached.get(path, 0) + self.limit)
        return dict(self.reached)

    def partitions(self, start: dict, end: dict) -> list[Chunks]:
        self.reached = {**self.reached, **{p: max(n, self.reached.get(p, 0)) for p, n in end.items()}}
        out = []
        for path in sorted(end):
            first, last = start.get(path, 0), end[path]
            out += [Chunks(stream_id(path), path, a, min(last, a + self.per_task)) for a in range(first, last, self.per_task)]
        return out

    def read(self, partition: Chunks) -> Iterator[tuple]:
        return _rows(partition, self.chunk)


def register(spark) -> None:
    spark.dataSource.register(SampleSource)
