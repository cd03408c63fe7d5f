"""Sinks (K1 to K4).  Operators return DataFrames; these put them into files, on any file system that a URI names."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow.fs
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system that a URI or an absolute path names, and the path in it."""
    if path.startswith("s3a://"):  # Hadoop's name for it
        path = "s3" + path[3:]
    return pyarrow.fs.FileSystem.from_uri(path)


def replace_file(path: str, content: bytes) -> None:
    """K3: a file's new content: written beside it first and then moved over it, so that a reader sees one or the other."""
    system, at = opened(path)
    folder = at.rpartition("/")[0]
    if folder:
        system.create_dir(folder, recursive=True)
    with system.open_output_stream(f"{at}.part") as f:
        f.write(content)
    system.move(f"{at}.part", at)


def write_named(df: DataFrame, root: str, name: str = "path", text: str = "html") -> None:
    """K1, K3: one file a row, named by the data, below a folder that all executors share; an equal name overwrites.

    A null text is an empty file.
    """

    def put(rows: Iterator[Row]) -> None:
        for r in rows:
            replace_file(f"{root.rstrip('/')}/{r[name]}", (r[text] or "").encode("utf-8"))

    df.select(name, text).foreachPartition(put)


def write_lines(df: DataFrame, root: str, name: str, order: list[str], text: str) -> None:
    """One text file a ``name``, its rows' texts as lines in ``order``: streamed, so that no file is held as a whole.

    A null text is an empty line.
    """

    def put(rows: Iterator[Row]) -> None:
        system, at = opened(root)
        system.create_dir(at, recursive=True)
        now, out = None, None
        for r in rows:
            if out is None or r[name] != now:
                if out is not None:
                    close(system, out, at, now)
                now = r[name]
                out = system.open_output_stream(f"{at}/{now}.txt.part")
            out.write(((r[text] or "") + "\n").encode("utf-8", "replace"))
        if out is not None:
            close(system, out, at, now)

    def close(system, out, at: str, now: str) -> None:
        out.close()
        system.move(f"{at}/{now}.txt.part", f"{at}/{now}.txt")

    df.select(name, *order, text).repartition(name).sortWithinPartitions(name, *order).foreachPartition(put)


def header_lines(df: DataFrame, root: str) -> None:
    """K2: ``link_id|title`` lines in order of ``pos``."""
    df.orderBy("pos").select(F.concat_ws("|", "link_id", "title")).write.mode("overwrite").text(root)


def catalogue(df: DataFrame, path: str) -> None:
    """K4: the catalogue as one indented JSON array, in its order; absent fields are left out.

    A catalogue is small (one entry a file of the library) and read whole by a browser.
    """
    rows = [json.loads(r[0]) for r in df.select(F.to_json(F.struct("novel", "title", "chapters", "path"))).toLocalIterator()]
    replace_file(path, json.dumps(rows, indent=2).encode("utf-8"))
