"""Folders listed by tasks, level by level (inventory S16, S17, R7).

``list_files`` lets Spark list, which keeps every path on the driver while
the plan is made. ``walk_files`` keeps them in a table: the folders of one
level are spread over tasks, each task lists its folders, and what it finds
is written to the shared scratch folder; the folders in there are the next
level. The driver learns only whether a level has folders. A folder is one
file-system listing and so belongs to one task, however many files it has.

A lost executor repeats its folders of the level; levels written stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.session import scratch_dir

_LEVEL = "path string, is_folder boolean, length bigint, modified_ms bigint, name string, source_path string"
_ROWS = 10_000  # rows of a batch that leaves a task

# Characters that a path written as a URI keeps as they are.
_URI_SAFE = "/-_.!~*'();:@&=+$,"


def _hidden(name: str) -> bool:
    """Names that file scans skip: markers and temporary files."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _as_uri(path: str) -> str:
    """The path as row lineage (``_metadata.file_path``) writes it: illegal
    ASCII characters are escaped, letters of any language are not."""
    return "".join(c if ord(c) > 127 else quote(c, safe=_URI_SAFE) for c in path)


def _list_folders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs as pafs

    names = [f.split(" ")[0] for f in _LEVEL.split(", ")]
    for batch in batches:
        for folder in batch["path"]:
            scheme, rest = folder.split(":", 1) if ":" in folder.split("/", 1)[0] else ("file", folder)
            root = "/" + rest.lstrip("/")
            if scheme == "file":
                store, at, prefix, inner = pafs.LocalFileSystem(), root, "file:", root
            else:
                authority = rest.lstrip("/").split("/", 1)[0]
                store, base = pafs.FileSystem.from_uri(f"{scheme}://{authority}/")
                inner = "/" + "/".join(rest.lstrip("/").split("/")[1:])
                at = base.rstrip("/") + inner
                prefix = f"{scheme}://{authority}"
            held: list[tuple] = []
            for info in store.get_file_info(pafs.FileSelector(at)):
                if _hidden(info.base_name):
                    continue
                full = inner.rstrip("/") + "/" + info.base_name
                ms = None if info.mtime_ns is None else info.mtime_ns // 1_000_000
                is_folder = info.type == pafs.FileType.Directory
                held.append((prefix + full, is_folder, None if is_folder else info.size, ms, info.base_name, prefix + _as_uri(full)))
                if len(held) >= _ROWS:
                    yield pd.DataFrame(held, columns=names)
                    held = []
            if held:
                yield pd.DataFrame(held, columns=names)


def walk_files(spark: SparkSession, root: str) -> DataFrame:
    """Every file below ``root``, with the columns of ``list_files``
    (path, length, modificationTime, name, source_path), as a stored table.

    Hidden names (``_`` or ``.`` first) and what is below them are left out,
    empty files are listed, an empty folder gives no row; a root that does
    not exist fails. Links to folders are followed, so a link to a folder
    above itself must not be there. Local, HDFS, S3, GCS and Azure paths can
    be listed from tasks; for other file systems use ``list_files``.
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions", "200") or 200)
    out = scratch_dir(spark, "walk")
    folders = spark.createDataFrame([(root.rstrip("/") or "/",)], "path string")
    level = 0
    while True:
        found = folders.repartition(tasks).mapInPandas(_list_folders, _LEVEL)
        found.write.parquet(f"{out}/level={level}")
        folders = spark.read.schema(_LEVEL).parquet(f"{out}/level={level}").where("is_folder").select("path")
        if folders.isEmpty():
            break
        level += 1
    schema = T._parse_datatype_string(_LEVEL)
    assert isinstance(schema, T.StructType)
    stored = spark.read.schema(schema.add("level", T.IntegerType())).parquet(out)
    return stored.where("not is_folder").select(
        "path", "length", F.timestamp_millis("modified_ms").alias("modificationTime"), "name", "source_path"
    )
