"""Binary files as folders of part files in order, written by their tasks and named when the job commits; `cat` of the parts is the file."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from strandloom.sources.layered import opened


@dataclass
class Parts(WriterCommitMessage):
    """What an attempt wrote: a file for each column."""

    part: int
    files: list[str]


class PartSink(DataSourceArrowWriter):
    """Each task writes one file for each column under its attempt's name; commit() gives the files of the attempts that count their
    last names and takes the rest away, abort() takes all away."""

    def __init__(self, options: dict) -> None:
        self.targets = json.loads(options["targets"])  # [column, folder, head, tail], head and tail in hex
        self.attempts = f"_attempts-{options['job']}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Parts:
        context, files, streams = TaskContext.get(), [], []
        for _, path, _, _ in self.targets:
            store, folder = opened(path)
            store.create_dir(f"{folder}/{self.attempts}", recursive=True)
            files.append(f"{folder}/{self.attempts}/{context.partitionId()}-{context.taskAttemptId()}")
            streams.append(store.open_output_stream(files[-1]))
        for batch in iterator:
            for (column, *_), stream in zip(self.targets, streams):
                for value in batch.column(batch.schema.names.index(column)):
                    if value.is_valid:
                        stream.write(value.as_buffer())
        for stream in streams:
            stream.close()
        return Parts(context.partitionId(), files)

    def commit(self, messages: list[Parts | None]) -> None:
        from pyarrow import fs

        for i, (_, path, head, tail) in enumerate(self.targets):
            store, folder = opened(path)
            store.create_dir(folder, recursive=True)
            for f in store.get_file_info(fs.FileSelector(folder)):
                if f.type == fs.FileType.File:
                    store.delete_file(f.path)
            for m in messages:
                if m is not None:
                    store.move(m.files[i], f"{folder}/part-{m.part + 1:06d}")
            for name, data in (("part-000000", head), ("part-999999", tail)):
                if data:
                    with store.open_output_stream(f"{folder}/{name}") as f:
                        f.write(bytes.fromhex(data))
        self.abort(messages)

    def abort(self, messages: list[Parts | None]) -> None:
        from pyarrow import fs

        for _, path, _, _ in self.targets:
            store, folder = opened(path)
            if store.get_file_info(f"{folder}/{self.attempts}").type != fs.FileType.NotFound:
                store.delete_dir(f"{folder}/{self.attempts}")


class PartSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "binary_parts"

    def writer(self, schema, overwrite: bool) -> PartSink:
        return PartSink(self.options)


def write_parts(rows: DataFrame, targets: list[tuple[str, str, bytes, bytes]]) -> None:
    """Write binary columns of rows in the order of their partitions, each (column, folder, head, tail) to its folder, in one pass.

    head goes before the first part and tail after the last. Paths are those that pyarrow opens: local folders that all tasks
    share, HDFS or an object store.
    """
    rows.sparkSession.dataSource.register(PartSource)
    told = json.dumps([[c, path, head.hex(), tail.hex()] for c, path, head, tail in targets])
    rows.select(*dict.fromkeys(c for c, *_ in targets)).write.format("binary_parts").option("targets", told).option("job", uuid.uuid4().hex).mode("append").save()
