"""Files by path or address inside tasks and data sources: local, HDFS, S3 and GCS, by Arrow's file systems."""

from __future__ import annotations

import re

import uuid

from pyarrow import fs
from pyspark.sql import SparkSession


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if path.startswith("file:"):
        path = re.sub("^file:/+", "/", path)
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def listed(path: str, suffix: str) -> list[fs.FileInfo]:
    """The file at path, or the files of a folder (one level) that end in suffix and don't begin with `_` or `.`, by name; none if it isn't there."""
    store, place = located(path)
    info = store.get_file_info(place)
    if info.type == fs.FileType.File:
        return [info]
    if info.type != fs.FileType.Directory:
        return []
    found = store.get_file_info(fs.FileSelector(place, allow_not_found=True))
    return sorted((f for f in found if f.is_file and f.base_name.endswith(suffix) and f.base_name[0] not in "_."), key=lambda f: f.path)


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which all executors share; only a local session may go without that setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "/tmp/checkpoints/paywire"
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/paywire-{label}-{uuid.uuid4().hex}"
