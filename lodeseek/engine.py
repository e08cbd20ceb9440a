"""The engine: index, search, read, list, status, export, import, re-embed, collect, remove, summarise."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar
from .operators import aggregates, changes, indexing, ivf, joins, maintenance, search, summarize
from .session import ship
from .sources import archive, config as configuration, git, git_tree, providers
from .sources.scan import scan
from .store import Store


#: Views of a scope that a scan of chunks is told by name; more are joined.
KNOWN_VIEWS = 100


def _hash(*parts: str) -> str:
    return hashlib.sha256(":".join(parts).encode()).hexdigest()


class Engine:
    """All operations over one store. Times are UTC; as_of can be given for repeatable runs.

    The models are those of the configuration, unless others are given.
    """

    def __init__(self, spark: SparkSession, folder: str, config: dict | None = None, embedder=None, summarizer=None, reranker=None):
        self.spark, self.store = ship(spark), Store(spark, folder)
        self.config = configuration.checked(configuration.merged(configuration.DEFAULTS, config or {}))
        self.embedder = embedder or providers.embedder_of(self.config["embeddings"])
        self.summarizer = summarizer or providers.summarizer_of(self.config["summarization"])
        self.reranker = reranker or providers.reranker_of(self.config["reranker"])

    # --- indexing ---

    def _now(self, as_of: str | None):
        return F.to_timestamp(F.lit(as_of or datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")))

    def _put(self, name: str, kind: str, path: str, view: tuple[str, str | None], files: DataFrame, as_of: str | None, state: git.Snapshot | None = None, paths: DataFrame | None = None, fingerprint: str | None = None, versions: DataFrame | None = None) -> dict:
        """Indexes files as a view and makes it the source's active one, in one commit that writes what changes.

        versions: (path, version, gone) to keep with it.
        """
        tables, now, change = self.store.tables(), self._now(as_of), self.store.change()
        source_id = _hash("source", name)
        view_id = _hash("view", name, *[x or "" for x in view])
        sizes = self.config["chunking"]
        try:
            done = indexing.index_view(files, view_id, tables, self.embedder, now, paths, sizes["maxTokens"], sizes["overlap"], change.scratch)
            gone = done.gone.select(F.lit(view_id).alias("source_view_id"), "path")
            some = not gone.isEmpty()
            here = F.col("source_view_id") == view_id
            n = {}
            for t, rows in (("indexed_files", done.files), ("chunks", done.chunks)):
                old = tables[t].where(here)
                n[t] = (old.join(gone, ["source_view_id", "path"], "left_anti") if some else old).count()
                if some:
                    change.remove(t, gone)
                n[t] += change.add(t, rows).count()
            change.add("file_blobs", done.blobs)
            contents = change.add("chunk_contents", done.contents)
            change.add("postings", search.postings(contents), in_runs=True)
            deferred = contents.where("embedding is null").count()
            s = state or git.Snapshot(path)
            one = self.spark.range(1)
            row = one.select(*[F.lit(v).cast(t).alias(k) for k, (v, t) in {"id": (source_id, "string"), "name": (name, "string"), "type": (kind, "string"), "path": (path, "string"), "git_url": (None, "string"), "repo_root_path": (s.root, "string"), "repo_subpath": (s.subpath, "string"), "active_view_id": (view_id, "string"), "config": (None, "string")}.items()], now.alias("last_indexed_at"), now.alias("created_at"), now.alias("updated_at"))
            view_row = one.select(*[F.lit(v).cast(t).alias(k) for k, (v, t) in {"id": (view_id, "string"), "source_id": (source_id, "string"), "view_kind": (view[0], "string"), "ref_name": (view[1], "string"), "head_commit_oid": (s.head, "string"), "head_tree_oid": (s.tree, "string"), "subtree_oid": (s.subtree, "string"), "dirty": (s.dirty, "boolean"), "snapshot_fingerprint": (fingerprint, "string"), "file_count": (n["indexed_files"], "int"), "chunk_count": (n["chunks"], "int")}.items()], now.alias("last_seen_at"), now.alias("created_at"))
            change.replace("sources", maintenance.upsert(tables["sources"], row, ["name"]))
            change.replace("source_views", maintenance.upsert(tables["source_views"], view_row, ["source_id", "view_kind", "ref_name"]))
            counts = indexing.counters(done.status, deferred)
            if versions is not None:
                of_source = change.scratch(versions.select(F.lit(name).alias("source"), "path", "version", "gone"))
                change.remove("versions", of_source.select("source", "path"))
                change.add("versions", of_source)
            change.commit()
        finally:
            change.drop()
        return counts | {"strategy": "full" if paths is None else "diff", "view_id": view_id}

    def _previous(self, view_id: str) -> changes.ViewState | None:
        r = self.store.table("source_views").where(F.col("id") == view_id).first()
        return r and changes.ViewState(r.head_commit_oid, r.head_tree_oid, r.subtree_oid, bool(r.dirty), r.snapshot_fingerprint)

    def index_path(self, path: str, name: str | None = None, include: list[str] | None = None, exclude: list[str] | None = None, as_of: str | None = None) -> dict:
        """Indexes a folder: a branch or detached view inside version control, else a workspace.

        The same clean tree is skipped; after a clean commit only what version control names is compared.
        """
        path = os.path.realpath(git.expand_home(path))
        name = name or os.path.basename(path)
        s = git.snapshot(path)
        view = (s.kind, s.ref)
        view_id = _hash("view", name, *[x or "" for x in view])
        files, _ = scan(self.spark, path, include, exclude)
        manifest = None
        if s.dirty or s.tree is None:
            manifest = aggregates.manifest_hash(files.select(F.lit(0).alias("k"), "path", F.sha2("content", 256).alias("content_hash")), "k").select("manifest").collect()
            manifest = manifest[0][0] if manifest else hashlib.sha256(b"").hexdigest()
        fingerprint = f"workspace:{manifest}" if s.tree is None else f"dirty:{s.subtree or s.tree}:{manifest}" if s.dirty else f"tree:{s.subtree or s.tree}"
        now = changes.ViewState(s.head, s.tree, s.subtree, s.dirty, fingerprint)
        before = self._previous(view_id)
        how = changes.strategy(before, now)
        if how == "skip":
            return {"new": 0, "deleted": 0, "unchanged": 0, "deferred": 0, "repaired": 0, "strategy": "skip", "view_id": view_id}
        paths = None
        if how == "diff" and before and before.head and git.is_ancestor(s.root, before.head):
            paths = git.changed_paths(self.spark, s, before.head)
        if s.kind == "branch":
            self._reconcile(name, git.branches(s.root))
        return self._put(name, "local", path, view, files, as_of, s, paths, fingerprint)

    def _reconcile(self, name: str, live: list[str]) -> None:
        """Removes views of branches that are gone."""
        tables = self.store.tables()
        stale = maintenance.stale_branches(tables["source_views"], _hash("source", name), live)
        if not stale.isEmpty():
            self._delete_views(tables, stale)

    def _delete_views(self, tables: dict[str, DataFrame], gone: DataFrame, source_name: str | None = None) -> None:
        """Removes views, what hangs on them, and a source if one is named, in one commit."""
        change = self.store.change()
        left = maintenance.delete_views(tables, gone) if source_name is None else maintenance.delete_source(tables, source_name)
        of_view = gone.select(F.col("id").alias("source_view_id"))
        for name in ("sources", "source_views"):
            change.replace(name, left[name])
        for name in ("indexed_files", "chunks"):
            change.remove(name, of_view)
        change.commit()

    def index_commit(self, root: str, ref: str, name: str | None = None, include: list[str] | None = None, exclude: list[str] | None = None, as_of: str | None = None, subpath: str | None = None) -> dict:
        """Indexes what a branch, or another name of a commit (a detached view), holds in a repository that executors see.

        No file is checked out. A tree that is indexed already is skipped; else the paths whose objects differ from those
        of the commit indexed before are compared, if that one is still there.
        """
        name = name or os.path.basename(root.rstrip("/"))
        head = git_tree.commit_of(root, ref)
        kind = ("branch", ref) if ref in git.branches(root) else ("detached", f"HEAD@{git.run(root, 'rev-parse', '--short', head).strip()}")
        whole = git.run(root, "rev-parse", f"{head}^{{tree}}").strip()
        part = git.run(root, "rev-parse", f"{head}:{subpath}").strip() if subpath else whole
        fingerprint = f"tree:{part}"
        s = git.Snapshot(root, subpath, *kind, head, whole, part)
        view_id = _hash("view", name, *kind)
        before = self._previous(view_id)
        how = changes.strategy(before, changes.ViewState(head, whole, part, False, fingerprint))
        if how == "skip":
            return {"new": 0, "deleted": 0, "unchanged": 0, "deferred": 0, "repaired": 0, "strategy": "skip", "view_id": view_id}
        files, _ = git_tree.scan(self.spark, root, head, subpath, include, exclude)
        known = how == "diff" and before and before.head and git_tree.has_commit(root, before.head)
        paths = git_tree.changed(self.spark, root, before.head, head, subpath) if known else None
        return self._put(name, "local", root, kind, files, as_of, s, paths, fingerprint)

    def index_git(self, url: str, branch: str = "main", folder: str | None = None, committed: bool | None = None, **options) -> dict:
        """Indexes a branch of a remote repository.

        committed: executors read its objects from a bare repository below folder, which they must see; by default so
        unless Spark runs in one process. Else it is checked out and scanned where the driver runs.
        """
        if committed is None:
            committed = not self.spark.sparkContext.master.startswith("local")
        shared = self.store.folder if "://" not in self.store.folder else (self.spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file://")
        if committed and not folder and (not shared or "://" in shared):
            raise ValueError("name a folder for repositories that all executors see")
        base = folder or (os.path.join(tempfile.gettempdir(), "lodeseek-clones") if "://" in self.store.folder and not committed else os.path.join(shared, "clones"))
        name = options.pop("name", None) or git.repo_name(url)
        if committed:
            target = os.path.join(base, f"{git.repo_name(url)}-{_hash(url)[:12]}.git")
            git_tree.fetch(url, branch, target)
            return self.index_commit(target, branch, name, **options)
        return self.index_path(git.clone_or_pull(url, branch, os.path.join(base, git.repo_name(url))), name, **options)

    def index_documents(self, name: str, files: DataFrame, ref: str | None = None, as_of: str | None = None) -> dict:
        """Indexes a DataFrame (path, content) as a source; with ref as a branch view, else as its workspace."""
        return self._put(name, "local", name, ("branch", ref) if ref else ("workspace", None), files, as_of)

    def index_changes(self, name: str, files: DataFrame, paths: DataFrame, as_of: str | None = None, versions: DataFrame | None = None) -> dict:
        """Puts some files of a workspace; named paths that aren't among files go. versions: see _put."""
        return self._put(name, "local", name, ("workspace", None), files, as_of, paths=paths, versions=versions)

    def forget_versions(self, below: int) -> int:
        """Forgets deletions of versions below a number; gives how many. Older versions of those paths count as new from then on."""
        change = self.store.change()
        gone = change.scratch(self.store.table("versions").where(F.col("gone") & (F.col("version") < below)).select("source", "path"))
        if n := gone.count():
            change.remove("versions", gone)
            change.commit()
        change.drop()
        return n

    def index_all(self) -> tuple[dict[str, dict], dict[str, str]]:
        """Every configured source; gives results and errors, and raises only if all fail."""
        done, errors = {}, {}
        for s in self.config["sources"]:
            try:
                if s["type"] == "git":
                    done[s["name"]] = self.index_git(s["url"], s.get("branch", "main"), name=s["name"], include=s.get("include"), exclude=s.get("exclude"))
                else:
                    done[s["name"]] = self.index_path(s["path"], s["name"], s.get("include"), s.get("exclude"))
            except Exception as e:  # noqa: BLE001  one source's failure leaves the others
                errors[s["name"]] = str(e)
        if errors and not done:
            raise RuntimeError("; ".join(f"{k}: {v}" for k, v in errors.items()))
        return done, errors

    def repair(self) -> int:
        """Chunks files that have no chunk from their blobs; gives how many files."""
        t = self.store.tables()
        sizes = self.config["chunking"]
        made = indexing.repaired(t["indexed_files"], t["chunks"], t["file_blobs"], sizes["maxTokens"], sizes["overlap"]).drop("content_hash").withColumnRenamed("id", "indexed_file_id").withColumn("chunk_content_hash", F.sha2("content", 256)).persist()
        n = made.select("indexed_file_id").distinct().count()
        if n:
            now = self._now(None)
            chunks = made.withColumns({"id": indexing.identity("indexed_file_id", F.col("ordinal").cast("string")), "metadata": indexing.metadata(), "created_at": now})
            new = made.select(F.col("chunk_content_hash").alias("content_hash"), "content").dropDuplicates(["content_hash"]).join(t["chunk_contents"].select("content_hash"), "content_hash", "left_anti")
            new = self.embedder.embed(new, "content", "embedding").withColumns({"summary": F.lit(None).cast("string"), "summary_embedding": F.lit(None).cast("array<float>"), "created_at": now})
            change = self.store.change()
            change.add("chunks", chunks)
            change.add("postings", search.postings(change.add("chunk_contents", new)), in_runs=True)
            change.commit()
        made.unpersist()
        return n

    # --- reading ---

    def scope(self, branch: str | None = None, source_id: str | None = None, source_name: str | None = None, **filters) -> search.Scope:
        """Views by default each source's active one; by branch where that exists, else none."""
        if source_id and source_name:
            raise ValueError("give a source's id or its name, not both")
        t = self.store.tables()
        sources = t["sources"]
        if source_name:
            sources = sources.where(F.col("name") == source_name)
            if sources.isEmpty():
                raise ValueError(f"no source {source_name}")
        if source_id:
            sources = sources.where(F.col("id") == source_id)
        views = joins.branch_views(sources, t["source_views"], branch) if branch else joins.default_views(sources, t["source_views"])
        ids = [r.id for r in views.select("id").limit(KNOWN_VIEWS + 1).collect()]
        return search.Scope(views.select("id"), known=tuple(ids) if len(ids) <= KNOWN_VIEWS else None, **filters)

    def options(self, top_k: int | None = None) -> search.Options:
        c = self.config["search"]
        w = {"text": c["bm25Weight"], "vector": c["vectorWeight"]}
        if c["useSummaryVector"]:
            w["summary"] = c["summaryVectorWeight"]
        return search.Options(w, c["rrf"]["k"], c["retrieveTopK"], top_k or c["finalTopK"], c["useSummaryVector"], reranker=self.reranker)

    def search(self, query: str, top_k: int | None = None, branch: str | None = None, source_id: str | None = None, source_name: str | None = None, source_type: str | None = None, path_prefix: str | None = None) -> DataFrame:
        """Results by place; at most retrieveTopK however large top_k (1 to 100) is."""
        if top_k is not None and not 1 <= top_k <= 100:
            raise ValueError("top_k is 1 to 100")
        scope = self.scope(branch, source_id, source_name, source_type=source_type, path_prefix=path_prefix)
        t, vector = self.store.tables(), self.embedder.query(query)
        near = (lambda hashes, k: self._near(hashes, vector, k)) if self.config["search"]["approximate"] and self.store.model() else None
        return search.search(t, query, vector, scope, self.options(top_k), self.store.table("postings"), near)

    def search_many(self, queries: DataFrame, top_k: int | None = None) -> DataFrame:
        """(query_id, rank, id, path, source_name, start_line, end_line, fused, text_score, vector_score) of many queries in one job.

        queries: query_id, query, embedding, and any of branch, source_name, source_type, path_prefix, null where they
        don't restrict. Results and ranks are those of one search a query, without a reranker.
        """
        names = ["branch", "source_name", "source_type", "path_prefix"]
        q = queries.select("query_id", "query", "embedding", *[F.col(c) if c in queries.columns else F.lit(None).cast("string").alias(c) for c in names])
        kinds = [tuple(r) for r in q.select(*names).distinct().collect()]  # scopes, not queries
        numbers = self.spark.createDataFrame([(i, *r) for i, r in enumerate(kinds)], search.SCOPE)
        same = [q[c].eqNullSafe(numbers[c]) for c in names]
        t, change = self.store.tables(), self.store.change()
        asked = q.join(F.broadcast(numbers), same[0] & same[1] & same[2] & same[3]).select("query_id", "query", "embedding", "scope")
        inside = change.scratch(search.scoped(numbers, t["sources"], t["source_views"], t["chunks"]))  # goes with vacuum, as the result is read later
        k = min(self.config["search"]["retrieveTopK"], top_k or self.config["search"]["finalTopK"])
        found = search.search_batch(t["chunk_contents"], asked, self.config["search"]["retrieveTopK"], self.options().weights, self.store.table("postings"), inside)
        found = found.where(F.col("rank") <= k).join(asked.select("query_id", "scope"), "query_id")
        at = inside.select("scope", F.col("content_hash").alias("id"), "at.path", "at.source_name", "at.start_line", "at.end_line")
        return found.join(at, ["scope", "id"]).select("query_id", "rank", "id", "path", "source_name", "start_line", "end_line", "fused", "text_score", "vector_score")

    def build_vector_index(self, lists: int = 64, target: float = 0.9, k: int = 50) -> dict:
        """Fits the approximate index on a bounded sample, codes every content's vector, measures recall, all in one commit.

        Queries are the contents of the smallest hashes; with search.approximate, searches then look into as many lists as
        reach the target. Later commits code what they add and remove what goes, so the lists hold the store's vectors.
        """
        rows = self.store.table("chunk_contents").where("embedding is not null").select("content_hash", "embedding")
        model, change = ivf.fitted(rows, "content_hash", "embedding", lists), self.store.change()
        change.index(None)
        index = change.add("vectors", ivf.coded(rows, "content_hash", "embedding", model))
        queries = rows.orderBy("content_hash").limit(100).select(F.col("content_hash").alias("query_id"), "embedding")
        model = ivf.calibrated(index, rows, queries, "query_id", "embedding", "content_hash", "embedding", model, k, target)
        change.model = self.store.files.at("models", uuid.uuid4().hex + ".json")
        self.store.files.create(change.model, json.dumps(model.held()))
        change.commit()
        return {"lists": len(model.centroids), "probes": model.probes, "recall": model.recall}

    def _near(self, hashes: DataFrame, vector: list[float], k: int) -> DataFrame | None:
        """(id, score) of about the k contents nearest to a vector among hashes, by the index; None without one."""
        path = self.store.model()
        if path is None:
            return None
        model = ivf.Model.of(json.loads(self.store.files.read(path)))
        if len(vector) != model.dimensions:
            return None
        inside = self.store.table("vectors").join(hashes.select("content_hash"), "content_hash", "left_semi")
        found = ivf.search(inside.select("list", "content_hash", "code", "embedding"), [(0, vector)], "content_hash", "embedding", model, k)
        return found.select(F.col("content_hash").alias("id"), "score")

    def read_source(self, chunk_id: str | None = None, path: str | None = None, header_path: str | None = None, start_line: int | None = None, end_line: int | None = None, context: int = 0, branch: str | None = None, source_name: str | None = None) -> dict | None:
        """A piece of a file by chunk, by heading or by coordinates, from its blob; from disk only without a branch.

        A branch that isn't there falls back to the active view, with a warning.
        """
        t, warning = self.store.tables(), None
        if chunk_id:
            rows = t["chunks"].where(F.col("id") == chunk_id)
        else:
            scope = self.scope(branch, source_name=source_name)
            if branch and scope.views.isEmpty():
                scope, warning = self.scope(source_name=source_name), f"no branch {branch}; the active view is read"
            rows = scope.of(t["chunks"]).where(F.col("path") == path)
            if header_path:
                rows = rows.where(F.col("header_path") == header_path)
        at = rows.orderBy("path", "ordinal", "id").limit(1)
        first = at.select("id", "path", "source_view_id", "start_line", "end_line", "chunk_content_hash", "indexed_file_id").first()
        if first is None:
            return self._from_disk(path, start_line, end_line, context, source_name) if path and not branch else None
        a, b = (first.start_line, first.end_line) if chunk_id or header_path else (start_line, end_line)
        if a is None and (chunk_id or header_path):
            body = t["chunk_contents"].where(F.col("content_hash") == first.chunk_content_hash).select("content").first()
            return {"path": first.path, "content": body.content, "start_line": None, "end_line": None, "warning": warning}
        f = t["indexed_files"].where(F.col("id") == first.indexed_file_id).select("content_hash")
        blob = t["file_blobs"].join(f, "content_hash", "left_semi")
        lo, hi, body = scalar.fragment(F.col("content"), F.lit(a).cast("int"), F.lit(b).cast("int"), F.lit(context))
        r = blob.select(lo.alias("a"), hi.alias("b"), body.alias("text")).first()
        return r and {"path": first.path, "content": r.text, "start_line": r.a, "end_line": r.b, "warning": warning}

    def _from_disk(self, path: str, start: int | None, end: int | None, context: int, source_name: str | None) -> dict | None:
        for s in self.store.table("sources").where(F.col("name") == source_name if source_name else F.lit(True)).collect():
            root = os.path.realpath(s.path or "")
            full = os.path.realpath(os.path.join(root, path))
            if os.path.commonpath([root, full]) == root and os.path.isfile(full):
                with open(full, encoding="utf-8", errors="replace") as f:
                    lines = f.read().split("\n")
                a = max(1, (start or 1) - context)
                b = min(len(lines), (end or start or len(lines)) + context)
                return {"path": path, "content": "\n".join(lines[a - 1 : b]), "start_line": a, "end_line": b, "warning": "read from disk"}
        return None

    def list_sources(self, kind: str | None = None, prefix: str | None = None, n: int | None = None) -> DataFrame:
        """Sources by name, with how many views and chunks they have."""
        t = self.store.tables()
        per = t["source_views"].groupBy("source_id").agg(F.count("*").alias("views"), F.sum("chunk_count").alias("chunks"))
        rows = aggregates.list_sources(t["sources"], kind, prefix, n)
        return rows.join(per, rows["id"] == per["source_id"], "left").drop("source_id").orderBy("name")

    def status(self) -> dict:
        t = self.store.tables()
        r = aggregates.status(t).first()
        return r.asDict()

    # --- maintenance ---

    def remove(self, name: str) -> bool:
        t = self.store.tables()
        if t["sources"].where(F.col("name") == name).isEmpty():
            return False
        self._delete_views(t, joins.views_of_source(t, name), name)
        return True

    def gc(self, grace_minutes: int = 60, as_of: str | None = None) -> dict[str, int]:
        """Removes contents and blobs that nothing uses; gives how many of each."""
        t = self.store.tables()
        as_of = as_of or datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
        change, n = self.store.change(), {}
        for name, used_by, key in (("chunk_contents", "chunks", "chunk_content_hash"), ("file_blobs", "indexed_files", "content_hash")):
            gone = change.scratch(joins.orphans(t[name], t[used_by], "content_hash", key, as_of, grace_minutes).select("content_hash"))
            n[name] = gone.count()
            if n[name]:
                for held in (name, "postings") if name == "chunk_contents" else (name,):
                    change.remove(held, gone)
        change.commit()
        return n

    def re_embed(self, source_name: str | None = None, force: bool = False) -> int:
        """Embeds contents that have no vector, or all with force; only a source's if one is named."""
        t = self.store.tables()
        k = t["chunk_contents"] if force else t["chunk_contents"].where("embedding is null")
        if source_name is not None:
            k = k.join(joins.reembed_selection(t, joins.views_of_source(t, source_name), force=force), "content_hash", "left_semi")
        todo = k.select("content_hash", "content")
        change = self.store.change()
        new = change.scratch(self.embedder.embed(todo, "content", "embedding").select("content_hash", "embedding").where("embedding is not null"))
        n = new.count()
        self._updated(change, t["chunk_contents"], new, ["embedding"])
        return n

    @staticmethod
    def _updated(change, contents: DataFrame, new: DataFrame, columns: list[str]) -> None:
        """Puts columns of new into the contents of their hash: those rows go and come back."""
        if not new.isEmpty():
            put = contents.drop(*columns).join(new.select("content_hash", *columns).dropDuplicates(["content_hash"]), "content_hash")
            change.remove("chunk_contents", new.select("content_hash"))
            change.add("chunk_contents", put)
            change.commit()
        change.drop()

    def summarize(self, source_name: str | None = None, limit: int | None = None, dry_run: bool = False, input_price: float = 0.0, output_price: float = 0.0) -> dict:
        """Summarises contents of the active views that have no summary; a second run finds none left."""
        if not self.config["summarization"]["enabled"]:
            raise RuntimeError("summarization isn't enabled")
        t = self.store.tables()
        views = t["source_views"].join(self.scope(source_name=source_name).views, "id", "left_semi")
        rows = summarize.inputs(t, views, limit)
        if dry_run:
            r = aggregates.dry_run(rows, 500, input_price, output_price).first()
            return r.asDict() | {"cost": scalar.format_cost(r.cost)}
        change = self.store.change()
        new = change.scratch(summarize.summarized(rows, self.summarizer, self.embedder))
        n = new.groupBy(F.regexp_extract("summary", r"^\[(skipped|failed):", 1).alias("state")).agg(F.count("*").alias("n")).collect()
        self._updated(change, t["chunk_contents"], new, ["summary", "summary_embedding"])
        return {(r.state or "summarized"): r.n for r in n}

    def export(self, target: str, names: list[str] | None = None, sql: bool = False) -> dict:
        names = names or [r.name for r in self.store.table("sources").select("name").collect()]
        return archive.export(self.store, names, target, sql)

    def import_(self, target: str, **options):
        return archive.import_(self.store, target, **options)
