"""Messages as .eml files: spark.read.format("mail"), a stream over growing folders, and a writer of one file for each id.

Two layouts. folders (the default): <root>/<account>/<mailbox, percent-encoded>/<uid>.eml, as a batch or a stream of landed rows; a
folder is cut into runs of uids by bytes, and a filter on account_id or mailbox leaves the other folders unlisted. A stream's
offset is the highest uid of each folder. ids: <root>/part-<task>/<id>.eml, what an export writes: each task fills a
folder of its own beside the others, and committing renames these folders, so that a failed or repeated task leaves no file and
readers never see half of one.

Paths may be local or shared folders, or URIs that pyarrow opens. Register the source once in a session: mail_files.register(spark).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote
from uuid import uuid4

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..schemas import LANDING

IDS = "id bigint, eml binary"
#: Bytes of messages that a task reads, about, and bytes of one batch of rows.
PART_BYTES, BATCH_BYTES = 128 << 20, 8 << 20
_UID = re.compile(r"(\d{1,18})\.eml")


def _opened(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root.removeprefix("file:"))


def _children(fs: pafs.FileSystem, path: str) -> list[pafs.FileInfo]:
    return fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))


def _messages(fs: pafs.FileSystem, path: str) -> list[tuple[int, int, int]]:
    """(number in the name, bytes, time of change in milliseconds) of the messages of one folder, in order."""
    found = [(m, f) for f in _children(fs, path) if f.type == pafs.FileType.File and (m := _UID.fullmatch(f.base_name))]
    return sorted((int(m[1]), f.size, (f.mtime_ns or 0) // 1_000_000) for m, f in found)


class Run(InputPartition):
    """Messages of one folder whose numbers lie in a range."""

    def __init__(self, folder: str, first: int, last: int):
        self.folder, self.first, self.last = folder, first, last


def _runs(folder: str, messages: list[tuple[int, int, int]], part_bytes: int) -> Iterator[Run]:
    first = size = 0
    for k, (_, n, _) in enumerate(messages):
        size += n
        if size >= part_bytes or k == len(messages) - 1:
            yield Run(folder, messages[first][0], messages[k][0])
            first, size = k + 1, 0


class MailReader(DataSourceReader):
    def __init__(self, root: str, layout: str, part_bytes: int, schema: StructType):
        self.root, self.layout, self.part_bytes, self.names = root, layout, part_bytes, schema.names
        self.only: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and self.layout == "folders" and f.attribute in (("account_id",), ("mailbox",)):
                self.only[f.attribute[0]] = self.only.get(f.attribute[0], values) & values
            else:
                yield f

    def folders(self) -> Iterator[str]:
        """Folders below the root that hold messages, by their relative paths."""
        fs, root = _opened(self.root)
        wanted = lambda column, value: column not in self.only or value in self.only[column]
        for a in _children(fs, root):
            if a.type != pafs.FileType.Directory or a.base_name.startswith((".", "_")):
                continue
            if self.layout == "ids":
                yield a.base_name
            elif a.base_name.isdecimal() and wanted("account_id", int(a.base_name)):
                for b in _children(fs, a.path):
                    if b.type == pafs.FileType.Directory and wanted("mailbox", unquote(b.base_name)):
                        yield f"{a.base_name}/{b.base_name}"

    def partitions(self) -> list[InputPartition]:
        # One folder's listing is held at a time; a partition names its first and last message only.
        fs, root = _opened(self.root)
        return [r for f in self.folders() for r in _runs(f, _messages(fs, f"{root}/{f}"), self.part_bytes)]

    def read(self, partition: Run | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing to read
            return
        fs, root = _opened(self.root)
        rows, held = [], 0
        for number, size, changed in _messages(fs, f"{root}/{partition.folder}"):
            if not partition.first <= number <= partition.last:
                continue
            with fs.open_input_stream(f"{root}/{partition.folder}/{number}.eml") as f:
                body = f.read()
            if self.layout == "ids":
                rows.append({"id": number, "eml": body})
            else:
                account, mailbox = partition.folder.split("/")
                rows.append({"account_id": int(account), "mailbox": unquote(mailbox), "uid": number, "internal_date": changed, "size": len(body), "body": body, "seq": number})
            held += len(body)
            if held > BATCH_BYTES:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({c: [r[c] for r in rows] for c in self.names})


class MailStreamReader(DataSourceStreamReader):
    """Offsets are the highest uid of each folder; uids of a folder rise."""

    def __init__(self, reader: MailReader):
        self.reader = reader

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        fs, root = _opened(self.reader.root)
        highest = {f: max((m[0] for m in _messages(fs, f"{root}/{f}")), default=None) for f in self.reader.folders()}
        return {f: n for f, n in highest.items() if n is not None}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        fs, root = _opened(self.reader.root)
        out = []
        for folder, last in end.items():
            new = [m for m in _messages(fs, f"{root}/{folder}") if start.get(folder, -1) < m[0] <= last]
            out += _runs(folder, new, self.reader.part_bytes)
        return out

    def read(self, partition: Run | None) -> Iterator[pa.RecordBatch]:
        return self.reader.read(partition)


@dataclass
class Written(WriterCommitMessage):
    """A task's folder."""

    folder: str


class MailWriter(DataSourceWriter):
    """One .eml for each row (id, eml); ids are to be distinct, as export() makes them."""

    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite, self.job = root, overwrite, f".writing-{uuid4().hex}"

    def write(self, rows) -> Written:
        fs, root = _opened(self.root)
        folder = f"part-{uuid4().hex}"
        fs.create_dir(f"{root}/{self.job}/{folder}", recursive=True)
        for row in rows:
            with fs.open_output_stream(f"{root}/{self.job}/{folder}/{row['id']}.eml", compression=None) as f:
                f.write(bytes(row["eml"] or b""))
        return Written(folder)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _opened(self.root)
        old = [f.path for f in _children(fs, root) if f.base_name.startswith("part-")] if self.overwrite else []
        for m in messages:
            if m is not None:
                fs.move(f"{root}/{self.job}/{m.folder}", f"{root}/{m.folder}")
        for path in old:
            fs.delete_dir(path)
        fs.delete_dir(f"{root}/{self.job}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = _opened(self.root)
        if fs.get_file_info(f"{root}/{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{self.job}")


class MailSource(DataSource):
    """Options: path; layout, folders or ids; part_bytes, what a task reads, about."""

    @classmethod
    def name(cls) -> str:
        return "mail"

    def _layout(self) -> str:
        layout = self.options.get("layout", "folders")
        if layout not in ("folders", "ids"):
            raise ValueError("layout is folders or ids")
        return layout

    def schema(self) -> str:
        return IDS if self._layout() == "ids" else LANDING

    def reader(self, schema: StructType) -> MailReader:
        return MailReader(self.options["path"], self._layout(), int(self.options.get("part_bytes", PART_BYTES)), schema)

    def streamReader(self, schema: StructType) -> MailStreamReader:
        return MailStreamReader(self.reader(schema))

    def writer(self, schema: StructType, overwrite: bool) -> MailWriter:
        if not {"id", "eml"} <= set(schema.names):
            raise ValueError("id and eml are needed")
        return MailWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session; filters reach readers in Python only where the session lets them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MailSource)


def export(raw: DataFrame, path: str, ids: DataFrame | None = None, mode: str = "overwrite") -> None:
    """Writes one .eml for each message, of all or of the ids; a message that stands twice is written once."""
    register(raw.sparkSession)
    chosen = raw if ids is None else raw.join(ids.select("id").distinct(), "id", "left_semi")
    chosen.select("id", "eml").repartition("id").dropDuplicates(["id"]).write.format("mail").mode(mode).save(path)
