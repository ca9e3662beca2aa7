"""Files of frames as a Spark data source and sink.

    spark.dataSource.register(FrameFiles)
    spark.read.format("weftline").load(path)              # one row for each frame
    df.write.format("weftline").mode("append").save(path)  # rows (frame_id, text); a file for each task

Reading takes the headers of a file first and deals its frames over tasks, so that a large file is
decoded in parallel. A task writes under a name of its own, and a file counts once its task has
succeeded and the job is committed.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "path string, frame_no int, mode string, format string, coder string, original long, compressed long, crc32 long, text string"


class _Span(InputPartition):
    """Frames of one file: (number, offset, size) of each."""

    def __init__(self, path: str, frames: list[tuple[int, int, int]]):
        super().__init__(0)
        self.path, self.frames = path, frames


class _Done(WriterCommitMessage):
    def __init__(self, made: str | None, path: str):
        self.made, self.path = made, path


def _local(path: str) -> str:
    return path[7:] if path.startswith("file://") else path


def files_in_order(path: str, suffix: str = "") -> list[str]:
    """A file, or the files of a folder in the order of their names."""
    path = _local(path)
    if os.path.isfile(path):
        return [path]
    return [p for n in sorted(os.listdir(path)) if n.endswith(suffix) and not n.startswith(("_", ".")) and os.path.isfile(p := os.path.join(path, n))]


class _Reader(DataSourceReader):
    def __init__(self, path: str, per_task: int):
        self.path, self.per_task = path, per_task

    def partitions(self) -> list[InputPartition]:
        from ..api import offsets

        out = []
        for path in files_in_order(self.path):
            spans = [(k, at, size) for k, (at, size) in enumerate(offsets(path))]
            out += [_Span(path, spans[k : k + self.per_task]) for k in range(0, len(spans), self.per_task)]
        return out or [_Span("", [])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from ..api import decompress, info

        if not partition.frames:
            return
        with open(partition.path, "rb") as f:
            for k, at, size in partition.frames:
                f.seek(at)
                blob = f.read(size)
                head = info(blob)[0]
                yield (partition.path, k, head["mode"], head["format"], head["coder"], head["original"], head["compressed"], head["crc32"], decompress(blob).decode())


class _Writer(DataSourceWriter):
    def __init__(self, path: str, mode: str, overwrite: bool):
        self.path, self.mode, self.overwrite = _local(path), mode, overwrite

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        from ..api import compress

        rows = [(r["frame_id"], r["text"]) for r in iterator]
        if not rows:
            return _Done(None, "")
        os.makedirs(self.path, exist_ok=True)
        name = f"{min(k for k, _ in rows):012d}-{uuid.uuid4().hex}.wft"
        made = os.path.join(self.path, f"_{name}")
        with open(made, "wb") as f:
            for _, text in sorted(rows):
                f.write(compress((text or "").encode(), self.mode))
        return _Done(made, os.path.join(self.path, name))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        if self.overwrite and os.path.isdir(self.path):
            for old in files_in_order(self.path, ".wft"):
                os.remove(old)
        for m in messages:
            if m is not None and m.made:
                os.rename(m.made, m.path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for m in messages:
            if m is not None and m.made and os.path.exists(m.made):
                os.remove(m.made)


class FrameFiles(DataSource):
    """Options: path, per_task (frames that a task reads, 16), mode (of the coder, fast)."""

    @classmethod
    def name(cls) -> str:
        return "weftline"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("per_task", "16")))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self.options.get("mode", "fast"), overwrite)
