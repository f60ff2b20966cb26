"""Records that a user-defined sink refuses: files written by tasks, which count once a manifest names them."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA = "record string, reason string"


def _open(uri: str) -> tuple[Any, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class RefusedFile:
    """The refused records of one task, as JSON lines; there is no file if there are none."""

    def __init__(self, uri: str):
        self.uri, self.name, self.out = uri, None, None

    def add(self, row: Any, reason: str) -> None:
        if self.out is None:
            files, root = _open(self.uri)
            files.create_dir(f"{root}/files")
            self.name = f"{uuid.uuid4().hex}.json"
            self.out = files.open_output_stream(f"{root}/files/{self.name}")
        record = json.dumps(row.asDict(recursive=True), default=str, ensure_ascii=False)
        self.out.write(json.dumps({"record": record, "reason": reason}, ensure_ascii=False).encode() + b"\n")

    def done(self) -> str | None:
        if self.out is not None:
            self.out.close()
        return self.name


def write_manifest(uri: str, name: str, files_named: Sequence[str]) -> None:
    """Written again under the same name it says what it said before, or what the repeated batch has."""
    files, root = _open(uri)
    files.create_dir(f"{root}/manifests")
    with files.open_output_stream(f"{root}/manifests/{name}") as out:
        out.write("\n".join(sorted(files_named)).encode())


def remove_manifest(uri: str, name: str) -> None:
    files, root = _open(uri)
    files.delete_file(f"{root}/manifests/{name}")


def read_refused(spark: SparkSession, path: str) -> DataFrame:
    """The refused records of all writes that were committed, as ``record`` (JSON) and ``reason``."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], SCHEMA)
    named = spark.read.text(f"{path}/manifests/*").where("value <> ''").distinct()
    if named.isEmpty():
        return spark.createDataFrame([], SCHEMA)
    records = spark.read.schema(SCHEMA).json(f"{path}/files").withColumn("_file", F.col("_metadata.file_name"))
    return records.join(named, records["_file"] == named["value"], "left_semi").select("record", "reason")
