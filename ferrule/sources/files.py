"""Source trees as tables."""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.functions.scalars import file_hash

#: Folders that hold no source of the project.
SKIP_SOURCE = ".git .hg .svn .venv venv env __pycache__ node_modules .tox .nox .mypy_cache .pytest_cache .ruff_cache build dist site-packages".split()
SKIP_KNOWN = ".git .hg .svn .venv venv __pycache__ node_modules .tox .mypy_cache .pytest_cache .ruff_cache".split()
#: What ends a line, as Python's splitlines has it.
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"


def read_tree(spark: SparkSession, root: str, batch: int = 512, size: int = 1 << 17) -> DataFrame:
    """path (relative, with slashes), content: all files under root, a folder or a URI that driver and executors see.

    Spark's own readers pass over empty files and names that start with a dot or an underscore, so __init__.py too; here names are listed on
    the driver and contents are read on the executors. A task has at most `batch` files, and `size` bytes if it has more than one: what is made of a
    file, by the same task, grows with its bytes.
    """
    at = root if "://" in root else os.path.abspath(root)
    store, base = fs.FileSystem.from_uri(at)
    base = base.rstrip("/")
    found = sorted((i.path[len(base) + 1 :], i.size or 0) for i in store.get_file_info(fs.FileSelector(base, recursive=True)) if i.type == fs.FileType.File)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(at)
        for b in batches:
            for name in chain.from_iterable(b.column(0).to_pylist()):
                with store.open_input_stream(f"{base.rstrip('/')}/{name}", compression=None) as f:
                    yield pa.RecordBatch.from_pydict({"path": [name], "content": pa.array([f.read()], pa.binary())})

    groups = dealt(found, batch, size)
    listed = spark.createDataFrame([(i, g) for i, g in enumerate(groups)], "task int, names array<string>")
    return listed.repartitionByRange(max(1, len(groups)), "task").select("names").mapInArrow(read, "path string, content binary")


def dealt(found: list[tuple[str, int]], batch: int, size: int) -> list[list[str]]:
    """Names (with their bytes) in groups, one for each task: of at most `batch` files and `size` bytes, unless a single file has more."""
    groups: list[list[str]] = []
    room = 0
    for name, n in found:
        if not groups or len(groups[-1]) == batch or n > room:
            groups.append([])
            room = size
        groups[-1].append(name)
        room -= n
    return groups


def _under(path: Column, names) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(n) for n in names]))


def source_files(tree: DataFrame) -> DataFrame:
    """Python files outside of caches, environments and hidden folders."""
    folders = F.split("path", "/")
    hidden = F.exists(F.slice(folders, 1, F.greatest(F.size(folders) - 1, F.lit(0))), lambda p: F.startswith(p, F.lit(".")))
    return tree.where(F.col("path").endswith(".py") & ~_under(F.col("path"), SKIP_SOURCE) & ~hidden)


def known_files(tree: DataFrame) -> DataFrame:
    """path of every file that a finding may name."""
    return tree.where(~_under(F.col("path"), SKIP_KNOWN)).select("path")


def source_lines(tree: DataFrame, size: int = 1 << 17) -> DataFrame:
    """file, n (from 1), text."""
    text = F.col("content").cast("string")
    lines = F.split(F.regexp_replace(text, f"({LINE_END})\\z", ""), LINE_END, -1)
    some = stretches(tree.where(F.length("content") > 0), size)
    return some.select(F.col("path").alias("file"), "before", F.posexplode(lines).alias("n", "text")).select("file", (F.col("n") + F.col("before") + 1).cast("int").alias("n"), "text")


def stretches(tree: DataFrame, size: int) -> DataFrame:
    """path, before (lines), content: long files in stretches of whole lines, so that no row holds all lines of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                path, content, at, before = b.column(0)[i].as_py(), b.column(1)[i].as_py(), 0, 0
                while at < len(content):
                    end = content.find(b"\n", at + size - 1) + 1 or len(content)
                    part = content[at:end]
                    yield pa.RecordBatch.from_pydict({"path": [path], "before": pa.array([before], pa.int64()), "content": pa.array([part], pa.binary())})
                    at = end
                    if at < len(content):
                        before += len(part.decode("utf-8", "replace").splitlines())

    return tree.select("path", F.col("content").cast("binary")).mapInArrow(run, "path string, before long, content binary")


def file_hashes(tree: DataFrame) -> DataFrame:
    return tree.select(F.col("path").alias("file"), file_hash(F.col("content")).alias("hash"))
