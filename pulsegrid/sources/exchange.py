"""Channels with exactly-once delivery, as a Spark data source: ``format("pulsegrid_channel")`` in batches and streams.

Writing has two phases. Tasks write files of their own below ``data/``; the driver then commits a batch by one manifest, ``log/<publisher>/<batch>``,
that names them. A batch whose manifest is there is never published again: a retry throws its own files away. Readers follow the
manifests alone, so they see neither files of failed tasks nor of batches in flight, and no message twice.

Files are read and written by ``pyarrow.fs``: ``path`` is a local path or a URI of a store that driver and executors reach.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "topic string, payload string, publisher string, batch long"


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _listed(path: str) -> list[str]:
    """Names of the files below a folder that may not be there."""
    from pyarrow import fs

    store, base = _store(path)
    return sorted(f.base_name for f in store.get_file_info(fs.FileSelector(base, allow_not_found=True)))


def _read(path: str) -> bytes:
    store, place = _store(path)
    with store.open_input_stream(place) as f:
        return f.read()


def _write(path: str, data: bytes) -> None:
    store, place = _store(path)
    store.create_dir(place.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(place) as f:
        f.write(data)


def _gone(path: str) -> None:
    store, place = _store(path)
    try:
        store.delete_file(place)
    except FileNotFoundError:
        pass


def committed(path: str) -> dict[str, list[int]]:
    """Numbers of the committed batches of each publisher."""
    return {name: sorted(int(b) for b in _listed(f"{path}/log/{name}") if b.isdigit()) for name in _listed(f"{path}/log")}


@dataclass
class Written(WriterCommitMessage):
    """File and number of rows of one task; no file where it had no rows."""

    file: str | None
    rows: int


class Files(InputPartition):
    """One file of a committed batch; no file where there is nothing to read, as Spark wants a partition at least."""

    def __init__(self, publisher: str = "", batch: int = -1, file: str | None = None):
        super().__init__(None)
        self.publisher, self.batch, self.file = publisher, batch, file


class _Publishing:
    def __init__(self, path: str, publisher: str):
        self.path, self.publisher = path, publisher

    def write(self, iterator: Iterator) -> Written:
        lines = [json.dumps([r["topic"], r["payload"]], ensure_ascii=False) for r in iterator if r["payload"] is not None]
        if not lines:
            return Written(None, 0)
        name = f"data/{uuid.uuid4().hex}"
        _write(f"{self.path}/{name}", "\n".join(lines).encode())
        return Written(name, len(lines))

    def _discard(self, messages: list) -> None:
        for m in messages:
            if m is not None and m.file:
                _gone(f"{self.path}/{m.file}")

    def _publish(self, messages: list, batch: int) -> None:
        """The manifest appears whole, by one move; the first one of a batch stays."""
        folder = f"{self.path}/log/{self.publisher}"
        if str(batch) in _listed(folder):
            self._discard(messages)
            return
        files = sorted((m.file, m.rows) for m in messages if m is not None and m.file)
        draft = f"{self.path}/drafts/{uuid.uuid4().hex}"
        _write(draft, json.dumps({"files": [{"file": f, "rows": n} for f, n in files]}).encode())
        store, place = _store(draft)
        target = _store(f"{folder}/{batch}")[1]
        store.create_dir(target.rsplit("/", 1)[0], recursive=True)
        store.move(place, target)


class StreamPublisher(_Publishing, DataSourceStreamWriter):
    """Batches are numbered by the query, so one publisher's name belongs to one query and its checkpoint."""

    def commit(self, messages, batchId: int) -> None:
        self._publish(messages, batchId)

    def abort(self, messages, batchId: int) -> None:
        self._discard(messages)


class BatchPublisher(_Publishing, DataSourceWriter):
    """A batch write takes the number behind the publisher's last one."""

    def commit(self, messages) -> None:
        self._publish(messages, max(committed(self.path).get(self.publisher, []), default=-1) + 1)

    def abort(self, messages) -> None:
        self._discard(messages)


def _files(path: str, publisher: str, batches: list[int]) -> list[Files]:
    return [Files(publisher, b, f["file"]) for b in batches for f in json.loads(_read(f"{path}/log/{publisher}/{b}"))["files"]]


def _rows(path: str, part: Files) -> Iterator[tuple]:
    if part.file is None:
        return
    for line in _read(f"{path}/{part.file}").decode().split("\n"):
        topic, payload = json.loads(line)
        yield topic, payload, part.publisher, part.batch


class _Batch(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Files]:
        return [f for name, batches in committed(self.path).items() for f in _files(self.path, name, batches)] or [Files()]

    def read(self, partition: Files) -> Iterator[tuple]:
        return _rows(self.path, partition)


class _Stream(DataSourceStreamReader):
    """Offset: the number of manifests read of each publisher, in the order of their batches."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {name: batches[-1] + 1 for name, batches in committed(self.path).items() if batches}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        known = committed(self.path)
        return [f for name, upto in end.items() for f in _files(self.path, name, [b for b in known.get(name, []) if start.get(name, 0) <= b < upto])] or [Files()]

    def read(self, partition: Files) -> Iterator[tuple]:
        return _rows(self.path, partition)

    def commit(self, end: dict) -> None:
        pass


class ChannelSource(DataSource):
    """Options: path, and for writers ``publisher`` (default ``main``). Rows to write have topic and payload; null payloads are left out."""

    @classmethod
    def name(cls) -> str:
        return "pulsegrid_channel"

    def schema(self) -> str:
        return SCHEMA

    @property
    def _path(self) -> str:
        return self.options["path"].rstrip("/")

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self._path)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self._path)

    def _named(self) -> str:
        name = self.options.get("publisher", "main")
        if not name.replace("-", "").replace("_", "").isalnum():
            raise ValueError("publisher must be made of letters, digits, - and _")
        return name

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a channel is only appended to")
        return BatchPublisher(self._path, self._named())

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return StreamPublisher(self._path, self._named())


def register(spark) -> None:
    spark.dataSource.register(ChannelSource)
