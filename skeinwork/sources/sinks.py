"""Writers: text lines, vocabularies, encodings, run records, losses, result tables."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def append_lines(df: DataFrame, path: str, column: str = "value") -> None:
    """Append one text column as lines."""
    df.select(F.col(column).alias("value")).write.mode("append").text(path)


def save_vocabulary(vocab: DataFrame, path: str) -> None:
    """Parquet ``(token, id)``, and the tokens as one text file in id order.

    A vocabulary holds some ten thousand rows, so one file is right here.
    """
    vocab.write.mode("overwrite").parquet(f"{path}/table")
    vocab.coalesce(1).sortWithinPartitions("id").select(F.col("token").alias("value")).write.mode("overwrite").text(
        f"{path}/text"
    )


def save_encodings(df: DataFrame, path: str) -> None:
    """Append rows by ``source`` folder, and a manifest with the row count of each source.

    Rows are written as they lie: a hot source stays spread over its tasks.
    """
    df.write.mode("append").partitionBy("source").parquet(f"{path}/rows")
    df.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows")).write.mode("append").parquet(f"{path}/manifest")


def append_run_records(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def append_losses(df: DataFrame, path: str) -> None:
    """Append ``(run, epoch, seq, loss)``; the folder can be read as a stream."""
    df.write.mode("append").parquet(path)


def save_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def save_named_files(df: DataFrame, path: str, name: str = "name", text: str = "text") -> int:
    """Write each row's text as a file of the given name, all of them or none; returns how many.

    Tasks write into folders of their own below ``path/_pending``, which no reader looks at. When all tasks are done the files
    of one attempt of each are moved into place, replacing files of the same names, and ``path/_commits`` gets a record of
    their count and bytes. Where a task fails for good nothing appears and the pending files are deleted; so too
    where a name is null, empty, holds a slash or comes twice, which are errors. A null text is an empty file.
    """
    spark = df.sparkSession
    spark.dataSource.register(NamedFiles)
    commit = uuid.uuid4().hex
    rows = df.select(F.col(name).cast("string").alias("name"), F.col(text).cast("string").alias("text"))
    rows.write.format(NamedFiles.name()).mode("append").option("commit", commit).save(path)
    return spark.read.schema("files long, bytes long").json(f"{path}/_commits/{commit}.json").first()["files"]


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    local = re.sub(r"^file:(//)?(?=/)", "", path)
    return (pafs.LocalFileSystem(), local) if local.startswith("/") else pafs.FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    """What one attempt of a task wrote: its folder below the pending one, files and bytes."""

    folder: str
    files: int
    size: int


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return NamedFilesWriter(self.options["path"], self.options["commit"])


class NamedFilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, commit: str) -> None:
        self.path, self.id = path.rstrip("/"), commit
        self.pending = f"{self.path}/_pending/{commit}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, pending = opened(self.pending)
        folder, done, size = uuid.uuid4().hex, set(), 0
        store.create_dir(f"{pending}/{folder}", recursive=True)
        for batch in iterator:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not file or "/" in file or file in done:
                    raise ValueError(f"not the name of one file: {file!r}")
                data = (content or "").encode()
                with store.open_output_stream(f"{pending}/{folder}/{file}") as out:
                    out.write(data)
                done.add(file)
                size += len(data)
        return Written(folder, len(done), size)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = opened(self.path)
        _, pending = opened(self.pending)
        written = [m for m in messages if m is not None]
        found = {}
        for message in written:
            for info in store.get_file_info(pafs.FileSelector(f"{pending}/{message.folder}")):
                if info.base_name in found:
                    raise ValueError(f"two rows name the file {info.base_name!r}")
                found[info.base_name] = info.path
        if len(found) != sum(m.files for m in written):
            raise ValueError("written files are missing")
        for file, at in found.items():
            store.move(at, f"{base}/{file}")
        store.create_dir(f"{base}/_commits", recursive=True)
        with store.open_output_stream(f"{base}/_commits/{self.id}.json") as out:
            out.write(json.dumps({"files": len(found), "bytes": sum(m.size for m in written)}).encode())
        self._clear(store, pending)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*opened(self.pending))

    def _clear(self, store: pafs.FileSystem, pending: str) -> None:
        if store.get_file_info(pending).type == pafs.FileType.Directory:
            store.delete_dir(pending)
