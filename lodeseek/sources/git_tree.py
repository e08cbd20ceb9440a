"""Committed trees as DataFrames: names by `git ls-tree`, contents by `git cat-file`, both asked by tasks.

The repository (bare or not, objects packed or loose) lies in a folder that all executors see, and they have git. The
driver lists the first level only; a lost task asks again, and a commit's objects never change. Symbolic links and
submodules are no files of a tree.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import git
from .filters import MAX_BYTES, included, keeps, visible

ENTRIES = pa.schema([("path", pa.string()), ("oid", pa.string()), ("size", pa.int64())])
CONTENTS = pa.schema([("path", pa.string()), ("bytes", pa.binary())])
#: Rows of names, and bytes of contents, that a task holds before it hands them on.
ROWS, BYTES = 10_000, 16 << 20


def commit_of(root: str, ref: str) -> str:
    return git.run(root, "rev-parse", "--verify", "--end-of-options", f"{ref}^{{commit}}").strip()


def has_commit(root: str, oid: str) -> bool:
    try:
        return commit_of(root, oid) == oid
    except (RuntimeError, OSError):
        return False


def fetch(url: str, branch: str, target: str) -> str:
    """A bare repository at target whose branch is that of url; earlier commits' objects stay. Gives the commit."""
    if not os.path.isdir(os.path.join(target, "objects")):
        os.makedirs(target, exist_ok=True)
        git.run(target, "init", "--bare", "--quiet")
    git.run(target, "fetch", "--quiet", "--depth", "1", "--", url, f"+refs/heads/{branch}:refs/heads/{branch}")
    return commit_of(target, branch)


def _entries(root: str, tree: str, recursive: bool) -> Iterator[tuple[str, str, str, str]]:
    """(type, oid, size, name) of a tree's entries, as git gives them."""
    asked = subprocess.Popen(["git", "ls-tree", "-z", "-l", *(["-r"] if recursive else []), tree], cwd=root, stdout=subprocess.PIPE, stderr=subprocess.PIPE)
    rest = b""
    while piece := asked.stdout.read(1 << 16):
        *lines, rest = (rest + piece).split(b"\0")
        for line in lines:
            head, name = line.split(b"\t", 1)
            mode, kind, oid, size = head.decode().split()
            yield "link" if mode == "120000" else kind, oid, size, name.decode("utf-8", "replace")
    errors = asked.stderr.read().decode("utf-8", "replace")
    if asked.wait():
        raise RuntimeError(errors.strip() or "git ls-tree failed")


def _named(rows: list[tuple[str, str, int]], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def tree(spark: SparkSession, root: str, commit: str, subpath: str | None = None) -> DataFrame:
    """(path, oid, size) of the files of a commit, below subpath if given; each first-level folder is listed by a task."""
    base = git.run(root, "rev-parse", "--verify", f"{commit}:{subpath.rstrip('/')}" if subpath else f"{commit}^{{tree}}").strip()
    first = list(_entries(root, base, False))
    own = spark.createDataFrame([(n, oid, int(size)) for kind, oid, size, n in first if kind == "blob"], "path string, oid string, size long")
    folders = [(n, oid) for kind, oid, _, n in first if kind == "tree"]
    if not folders:
        return own

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = []
        for batch in batches:
            for one in batch.to_pylist():
                for kind, oid, size, name in _entries(root, one["oid"], True):
                    if kind == "blob":
                        rows.append((f"{one['name']}/{name}", oid, int(size)))
                    if len(rows) >= ROWS:
                        yield _named(rows, ENTRIES)
                        rows = []
        if rows:
            yield _named(rows, ENTRIES)

    below = spark.createDataFrame(folders, "name string, oid string").repartition(min(len(folders), spark.sparkContext.defaultParallelism), "name")
    return own.unionByName(below.mapInArrow(listed, "path string, oid string, size long"))


def contents(files: DataFrame, root: str) -> DataFrame:
    """(path, bytes) of files (path, oid, size), dealt by object over the shuffle's partitions."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = subprocess.Popen(["git", "cat-file", "--batch"], cwd=root, stdin=subprocess.PIPE, stdout=subprocess.PIPE)
        try:
            rows, held = [], 0
            for batch in batches:
                for one in batch.to_pylist():
                    asked.stdin.write(one["oid"].encode() + b"\n")
                    asked.stdin.flush()
                    head = asked.stdout.readline().split()
                    if len(head) != 3:
                        raise RuntimeError(f"no object {one['oid']} in {root}")
                    found = asked.stdout.read(int(head[2]))
                    asked.stdout.read(1)
                    rows.append((one["path"], found))
                    held += len(found)
                    if held >= BYTES or len(rows) >= ROWS:
                        yield _named(rows, CONTENTS)
                        rows, held = [], 0
            if rows:
                yield _named(rows, CONTENTS)
        finally:
            asked.stdin.close()
            asked.kill()
            asked.wait()

    return files.select("path", "oid").repartition("oid").mapInArrow(read, "path string, bytes binary")


def _lines(root: str, commit: str, path: str) -> list[str]:
    try:
        return git.run(root, "show", f"{commit}:{path}").splitlines()
    except RuntimeError:
        return []


def scan(spark: SparkSession, root: str, commit: str, subpath: str | None = None, include: list[str] | None = None, exclude: list[str] | None = None, ownignore: str = ".lodeseekignore") -> tuple[DataFrame, DataFrame]:
    """(files, excluded) of a commit by the rules of scan.scan: files (path, content) and excluded (path), both lazy.

    Names and sizes are filtered before any content is read. Empty files are left out, as Spark leaves them out of a folder.
    """
    head = f"{subpath.rstrip('/')}/" if subpath else ""
    raw = tree(spark, root, commit, subpath).where("size > 0").where(visible(F.col("path")) & included(F.col("path"), include or []))
    ok = keeps(F.col("path"), _lines(root, commit, head + ".gitignore"), _lines(root, commit, head + ownignore), exclude or []) & (F.col("size") <= MAX_BYTES)
    return contents(raw.where(ok), root).select("path", F.decode("bytes", "UTF-8").alias("content")), raw.where(~ok).select("path")


def changed(spark: SparkSession, root: str, old: str, new: str, subpath: str | None = None) -> DataFrame:
    """(path) of files that differ between two commits, by their objects' ids; a path of one commit only differs."""
    a, b = (tree(spark, root, c, subpath).select("path", F.col("oid").alias(n)) for c, n in ((old, "before"), (new, "after")))
    return a.join(b, "path", "full_outer").where(~F.col("before").eqNullSafe(F.col("after"))).select("path")
