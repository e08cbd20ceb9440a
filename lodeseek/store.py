"""A store of Parquet tables on any file system that Hadoop reads: parts that are appended, deletions beside them, a log of commits.

A table is a list of entries: parts with rows, and deletions with the keys of rows that go from the parts before them.
A commit writes new parts and deletions only, then one log file that lists all entries of all tables; so indexing
a few files writes about their bytes, whatever the size of the store. Before a commit, the last parts of a table are merged
once FAN of them are of one tier of size (FAN times as many rows a tier), with the deletions between them; so parts grow with
the logarithm of the commits, and a row is written again once a tier. `compact` makes one part of a table's entries,
`vacuum` removes what the last commit doesn't name.

Rows of a part are sorted by what reads look for (ORDER), so Parquet's statistics of row groups and pages leave out what a
term, a view or a path prefix doesn't touch.
"""

from __future__ import annotations

import json
import uuid
from itertools import takewhile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 3
VECTOR = "array<float>"
TABLES = {
    "sources": "id string, name string, type string, path string, git_url string, repo_root_path string, repo_subpath string, active_view_id string, config string, last_indexed_at timestamp, created_at timestamp, updated_at timestamp",
    "source_views": "id string, source_id string, view_kind string, ref_name string, head_commit_oid string, head_tree_oid string, subtree_oid string, dirty boolean, snapshot_fingerprint string, file_count int, chunk_count int, last_seen_at timestamp, created_at timestamp",
    "file_blobs": "content_hash string, content string, byte_size long, created_at timestamp",
    "indexed_files": "id string, source_view_id string, path string, content_hash string, indexed_at timestamp",
    "chunk_contents": f"content_hash string, content string, embedding {VECTOR}, summary string, summary_embedding {VECTOR}, created_at timestamp",
    "chunks": "id string, source_view_id string, indexed_file_id string, chunk_content_hash string, path string, source_type string, start_line int, end_line int, header_path string, language string, ordinal int, metadata string, created_at timestamp",
}
#: Tables beside them: postings and coded vectors of chunk contents, and the last version of each path that a stream has brought.
DERIVED = {
    "postings": "term string, content_hash string, at array<int>",
    "vectors": f"list int, content_hash string, code binary, embedding {VECTOR}",
    "versions": "source string, path string, version long, gone boolean",
}
SCHEMAS = TABLES | DERIVED
#: What the rows of a part are sorted by; hashes order at random, so only for terms, views, lists and paths.
ORDER = {"postings": ("term", "content_hash"), "vectors": ("list", "content_hash"), "chunks": ("source_view_id", "path"), "indexed_files": ("source_view_id", "path"), "versions": ("source", "path")}
#: Tables that aren't shuffled for their order: each task's rows are sorted, so it has few contents, whose hashes a dictionary holds.
IN_RUNS = ("postings",)
#: Bytes of a row group of a sorted part.
GROUP_BYTES = 4 << 20
#: Parts of a tier that are merged into one of the next, and the rows of the lowest tier.
FAN, LOWEST = 8, 10_000
#: A table with more deletions than this is made one part before the next commit.
MOST_DELETIONS = 16


def tier(rows: int) -> int:
    n = 0
    while rows > LOWEST:
        rows, n = rows // FAN, n + 1
    return n


class Files:
    """A folder through Hadoop's file systems: local paths and URIs alike."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.conf, self.folder = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), folder.rstrip("/")

    def at(self, *parts: str) -> str:
        return "/".join([self.folder, *parts])

    def _path(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        system, p = self._path(path)
        return system.exists(p)

    def names(self, path: str) -> list[str]:
        system, p = self._path(path)
        return sorted(s.getPath().getName() for s in system.listStatus(p)) if system.exists(p) else []

    def read(self, path: str) -> str:
        system, p = self._path(path)
        stream = system.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, path: str, text: str = "") -> bool:
        """Writes a new file; False if it is there already."""
        system, p = self._path(path)
        system.mkdirs(p.getParent())
        try:
            stream = system.create(p, False)
        except Exception as e:  # noqa: BLE001  Java's exception for a file that exists
            if system.exists(p):
                return False
            raise e
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def rename(self, old: str, new: str) -> None:
        system, p = self._path(old)
        if not system.rename(p, self._path(new)[1]):
            raise RuntimeError(f"{old} could not become {new}")

    def walk(self, path: str) -> list[str]:
        """The files below a folder, as paths relative to it."""
        system, p = self._path(path)
        found, top = system.listFiles(p, True), system.makeQualified(p).toString().rstrip("/") + "/"
        out = []
        while found.hasNext():
            out.append(found.next().getPath().toString().removeprefix(top))
        return sorted(out)

    def fetch(self, path: str, local: str) -> None:
        """A file to the driver's disk."""
        system, p = self._path(path)
        system.copyToLocalFile(False, p, self.jvm.org.apache.hadoop.fs.Path("file://" + local), True)

    def send(self, local: str, path: str) -> None:
        """A file of the driver's disk to a path, in place of what is there."""
        system, p = self._path(path)
        system.copyFromLocalFile(False, True, self.jvm.org.apache.hadoop.fs.Path("file://" + local), p)

    def delete(self, path: str) -> None:
        system, p = self._path(path)
        system.delete(p, True)


class Change:
    """What one commit will change. Rows are written at once, and show up with commit()."""

    def __init__(self, store: "Store"):
        self.store, (self.base, self.state) = store, store.current()
        self.entries = {name: list(self.state.get(name, [])) for name in SCHEMAS}
        self.model = store.model()
        self.held: list[str] = []

    def scratch(self, df: DataFrame) -> DataFrame:
        """df as a written table that goes with the commit, so it isn't computed again."""
        path = self.store.files.at("scratch", uuid.uuid4().hex)
        self.held.append(path)
        df.write.option("compression", "zstd").parquet(path)
        return self.store.spark.read.schema(df.schema).parquet(path)

    def add(self, name: str, df: DataFrame, in_runs: bool = False) -> DataFrame:
        """Appends rows; gives them as written. Vectors of chunk contents are coded as well, if there is an index of them.

        in_runs: each task's rows come in sorted runs (postings), and are written as they come.
        """
        part = uuid.uuid4().hex
        path = self.store.files.at(name, part)
        rows, writer = df.select(*[f.split()[0] for f in SCHEMAS[name].split(", ")]), {"compression": "zstd"}
        if name in ORDER:
            writer |= {"parquet.block.size": str(GROUP_BYTES), "parquet.dictionary.page.size": str(GROUP_BYTES)}
            if name not in IN_RUNS:
                rows = rows.repartitionByRange(*ORDER[name])
            if not in_runs:
                rows = rows.sortWithinPartitions(*ORDER[name])
        rows.write.options(**writer).parquet(path)
        out = self.store.spark.read.schema(SCHEMAS[name]).parquet(path)
        self.entries[name].append({"rows": part, "n": out.count()})
        if name == "chunk_contents" and self.model:
            self._coded(out)
        return out

    def _coded(self, contents: DataFrame) -> None:
        """Codes of new contents; an index of vectors of another length ends with this commit."""
        from .operators import ivf

        rows = contents.where("embedding is not null").select("content_hash", "embedding")
        sizes = rows.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
        model = ivf.Model.of(json.loads(self.store.files.read(self.model)))
        if sizes[0] is None:
            return
        if set(sizes) != {model.dimensions}:
            self.index(None)
        else:
            self.add("vectors", ivf.coded(rows, "content_hash", "embedding", model))

    def index(self, model: str | None) -> None:
        """Another model (the path of its file) for the vectors, or none; the coded vectors begin anew."""
        self.model, self.entries["vectors"] = model, []

    def remove(self, name: str, keys: DataFrame) -> None:
        """Removes the rows that have a row of keys (columns of the table, not null)."""
        part = uuid.uuid4().hex
        keys.distinct().write.parquet(self.store.files.at(name, part))
        self.entries[name].append({"gone": part, "by": keys.columns})
        if name == "chunk_contents" and self.model:
            self.remove("vectors", self.store.spark.read.schema(keys.schema).parquet(self.store.files.at(name, part)))

    def replace(self, name: str, df: DataFrame) -> DataFrame:
        """The whole table anew; for small tables."""
        self.entries[name] = []
        if name == "chunk_contents":
            self.entries["vectors"] = []
        return self.add(name, df)

    def commit(self) -> None:
        self.store._swap(self.base, self.entries, self.model)
        self.drop()

    def drop(self) -> None:
        for path in self.held:
            self.store.files.delete(path)
        self.held = []


class Store:
    """Tables below a folder (a path or a URI); one writer at a time, which a lock file for each commit makes sure of.

    A reader takes the entries that the log names when it asks; a commit never changes what a reader has.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.files = spark, folder, Files(spark, folder)
        self._last: tuple[str, dict] = ("", {})

    def current(self) -> tuple[int, dict[str, list[dict]]]:
        """Number of the last commit, 0 for none, and its entries; older stores are migrated."""
        done = [n for n in self.files.names(self.files.at("log")) if n.endswith(".json")]
        if not done:
            return self._from_pointer() if self.files.exists(self.files.at("current.json")) else (0, {})
        state = self._state(done[-1])
        if state["schema"] > SCHEMA_VERSION:
            raise RuntimeError(f"the store has schema {state['schema']}, not {SCHEMA_VERSION}")
        at = int(done[-1].split(".")[0])
        return (at, state["tables"]) if state["schema"] == SCHEMA_VERSION else self._with_postings(at, state["tables"])

    def _state(self, log: str) -> dict:
        """A log file's content; the last one is kept, as log files never change."""
        if self._last[0] != log:
            self._last = log, json.loads(self.files.read(self.files.at("log", log)))
        return self._last[1]

    def model(self) -> str | None:
        """The file of the model that vectors are coded by, if there is an index."""
        at = self.current()[0]
        return self._state(f"{at:012d}.json").get("model") if at else None

    def _from_pointer(self) -> tuple[int, dict[str, list[dict]]]:
        """From schema 1 (a pointer to one folder a table, no postings)."""
        old = json.loads(self.files.read(self.files.at("current.json")))
        if old["schema"] != 1:
            raise RuntimeError(f"the store has schema {old['schema']}, not {SCHEMA_VERSION}")
        out = self._with_postings(0, {name: [{"rows": part}] for name, part in old["tables"].items()})
        self.files.delete(self.files.at("current.json"))
        return out

    def _with_postings(self, at: int, tables: dict[str, list[dict]]) -> tuple[int, dict[str, list[dict]]]:
        """From schemas 1 and 2 (postings in folders by bucket, parts without their numbers of rows)."""
        from .operators.search import postings

        def counted(name: str, entry: dict) -> dict:
            return entry if "gone" in entry else entry | {"n": self.spark.read.schema(SCHEMAS[name]).parquet(self.files.at(name, entry["rows"])).count()}

        self._swap(at, {name: [counted(name, e) for e in entries] for name, entries in tables.items() if name in TABLES})
        change = Change(self)
        change.add("postings", postings(self.table("chunk_contents")), in_runs=True)
        change.commit()
        return self.current()

    def _swap(self, base: int, entries: dict[str, list[dict]], model: str | None = None) -> None:
        name = f"{base + 1:012d}"
        if not self.files.create(self.files.at("log", name + ".lock")):
            raise RuntimeError(f"another writer has begun commit {base + 1}; if it has died, delete its lock")
        self.files.create(self.files.at("log", name + ".new"), json.dumps({"schema": SCHEMA_VERSION, "tables": entries, "model": model}))
        self.files.rename(self.files.at("log", name + ".new"), self.files.at("log", name + ".json"))

    def table(self, name: str) -> DataFrame:
        return self._rows(name, self.current()[1].get(name, []))

    def _rows(self, name: str, entries: list[dict]) -> DataFrame:
        out, parts = None, []

        def flush() -> None:
            nonlocal out, parts
            if parts:
                df = self.spark.read.schema(SCHEMAS[name]).parquet(*[self.files.at(name, p) for p in parts])
                out, parts = df if out is None else out.unionByName(df), []

        for entry in entries:
            if "rows" in entry:
                parts.append(entry["rows"])
            else:
                flush()
                if out is not None:
                    keys = self.spark.read.parquet(self.files.at(name, entry["gone"]))
                    out = out.join(keys, entry["by"], "left_anti").select(*out.columns)
        flush()
        return self.spark.createDataFrame([], SCHEMAS[name]) if out is None else out

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in TABLES}

    def change(self) -> Change:
        """A change to be committed; full tiers are merged first, and tables with many deletions made one part."""
        state = self.current()[1]
        many = [name for name, entries in state.items() if sum("gone" in e for e in entries) > MOST_DELETIONS]
        merged = {name: tail for name in state if name not in many and (tail := self._full_tier(state[name])) is not None}
        if many or merged:
            change = Change(self)
            for name in many:
                change.replace(name, self.table(name))
            for name, first in merged.items():
                entries = change.entries[name]
                # Deletions among the merged parts hold for the parts before them too, so they come before the new part.
                change.entries[name] = entries[:first] + ([e for e in entries[first:] if "gone" in e] if first else [])
                if name == "chunk_contents":  # their coded vectors stay as they are
                    model, change.model = change.model, None
                change.add(name, self._rows(name, entries[first:]))
                if name == "chunk_contents":
                    change.model = model
            change.commit()
        return Change(self)

    @staticmethod
    def _full_tier(entries: list[dict]) -> int | None:
        """Where the last parts begin that fill a tier: FAN of it, with the smaller ones among them; None if none is full."""
        parts = [(i, tier(e.get("n", 0))) for i, e in enumerate(entries) if "rows" in e]
        for t in sorted({t for _, t in parts}):
            last = list(takewhile(lambda part: part[1] <= t, reversed(parts)))
            if sum(x == t for _, x in last) >= FAN:
                return last[-1][0]
        return None

    def commit(self, replaced: dict[str, DataFrame]) -> None:
        """Replaces whole tables, all at once."""
        change = Change(self)
        for name, df in replaced.items():
            change.replace(name, df)
        change.commit()

    def compact(self, name: str) -> None:
        """Makes one part of a table's parts and deletions."""
        self.commit({name: self.table(name)})

    def vacuum(self) -> int:
        """Removes what the last commit doesn't name; for times without readers and writers. Gives how many parts went."""
        at, entries = self.current()
        n = 0
        for name in SCHEMAS:
            held = {e.get("rows") or e.get("gone") for e in entries.get(name, [])}
            for part in self.files.names(self.files.at(name)):
                if part not in held:
                    self.files.delete(self.files.at(name, part))
                    n += 1
        for log in self.files.names(self.files.at("log")):
            if int(log.split(".")[0]) < at:
                self.files.delete(self.files.at("log", log))
        self.files.delete(self.files.at("scratch"))
        held = self.model()
        for file in self.files.names(self.files.at("models")):
            if self.files.at("models", file) != held:
                self.files.delete(self.files.at("models", file))
        return n
