"""Hybrid search over chunk contents: scope, channels, occurrences, fusion, hydration, rerank."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar, text, vector
from .fusion import K, WEIGHTS_2, WEIGHTS_3, best, fused

NARROW, RETRIEVE, FINAL = 10_000, 50, 10


@dataclass
class Scope:
    """Which occurrences a search may return; None is no restriction. views: a frame with the id of each view.

    known: the views' ids where they are few, so the scan of chunks leaves out other views' row groups.
    """

    views: DataFrame | None = None
    source_type: str | None = None
    path_prefix: str | None = None
    known: tuple[str, ...] | None = None

    def of(self, chunks: DataFrame) -> DataFrame:
        if self.known is not None:
            chunks = chunks.where(F.col("source_view_id").isin(*self.known))
        elif self.views is not None:
            chunks = chunks.join(self.views.select(F.col("id").alias("source_view_id")), "source_view_id", "left_semi").select(*chunks.columns)
        if self.source_type is not None:
            chunks = chunks.where(F.col("source_type") == self.source_type)
        if self.path_prefix:
            chunks = chunks.where(F.col("path").startswith(self.path_prefix))
        return chunks


class Reranker(Protocol):
    """Reorders candidates: gets a frame with id, content, place and gives it with a `rerank_score`, best first."""

    def rerank(self, query: str, candidates: DataFrame, n: int) -> DataFrame: ...


class Passthrough:
    """Keeps the order; every score is 1."""

    def rerank(self, query: str, candidates: DataFrame, n: int) -> DataFrame:
        return candidates.orderBy("place").limit(n).withColumn("rerank_score", F.lit(1.0))


class ScoreReranker:
    """Reranks by a column made from the query and the content."""

    def __init__(self, score):
        self.score = score

    def rerank(self, query: str, candidates: DataFrame, n: int) -> DataFrame:
        return candidates.withColumn("rerank_score", self.score(query, F.col("content")).cast("double")).orderBy(F.desc("rerank_score"), "place").limit(n)


def scope_hashes(chunks: DataFrame, scope: Scope) -> DataFrame:
    """Distinct content hashes in scope."""
    return scope.of(chunks).select(F.col("chunk_content_hash").alias("content_hash")).distinct()


def text_search(contents: DataFrame, query: str, k: int, unicode_clean: bool = False) -> DataFrame:
    """(id, score) of the k best contents that hold every term; no row if the query has no term.

    A `contains` for each term comes first, so most rows are never tokenised.
    """
    terms = text.query_terms(query, unicode_clean)
    rows = contents.select(F.col("content_hash").alias("id"), "content")
    if not terms:
        return rows.select("id", F.lit(0.0).alias("score")).limit(0)
    low = F.lower("content")
    for t in terms:
        rows = rows.where(F.contains(low, F.lit(t)))
    names = [f"p{i}" for i in range(len(terms))]
    placed = lambda toks: F.struct(*[text.positions(toks, F.lit(t)).alias(n) for t, n in zip(terms, names)])
    score = vector.let(vector.let(text.tokens(F.col("content")), placed), lambda s: text.rank([s[n] for n in names]))
    # A filter on the score below the limit would compute it twice.
    scored = rows.select("id", F.round(score, 6).alias("score")).orderBy(F.desc_nulls_last("score"), "id").limit(k)
    return scored.where("score is not null")


#: Tokens and contents of a run of postings, which is sorted in a task's memory.
RUN_TOKENS, RUN_CONTENTS = 2_000_000, 8_192


def _run(contents: pa.Array, toks: pa.Array) -> Iterator[pa.RecordBatch]:
    """The postings of some contents, by term and content."""
    coded = toks.flatten().dictionary_encode()
    rank_of = lambda values: np.argsort(pc.sort_indices(values).to_numpy(), kind="stable")
    code, n = coded.indices.to_numpy(), toks.value_lengths().to_numpy()
    text_of = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(code)) - np.repeat(np.cumsum(n) - n, n) + 1
    order = np.lexsort((rank_of(contents)[text_of], rank_of(coded.dictionary)[code]))  # stable: positions ascend
    code, text_of, at = code[order], text_of[order], at[order].astype(np.int32)
    heads = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (text_of[1:] != text_of[:-1])))
    size = np.diff(np.append(heads, len(code)))
    keep = np.arange(len(code)) - np.repeat(heads, size) < text.POSITIONS
    ends = np.concatenate([[0], np.cumsum(np.minimum(size, text.POSITIONS))]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(at[keep]))
    for k in range(0, len(heads), 1 << 16):
        some = heads[k : k + (1 << 16)]
        yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(code[some])), contents.take(pa.array(text_of[some])), lists.slice(k, len(some))], ["term", "content_hash", "at"])


def postings(contents: DataFrame) -> DataFrame:
    """(term, content_hash, at): the first positions of each term in each content, made in the row: nothing is shuffled.

    A task gives them in runs of RUN_TOKENS or RUN_CONTENTS at most, each by term and content. A run has few contents, so
    a Parquet file's dictionary holds their hashes once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tokens, rows = [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                table = pa.Table.from_batches(held).combine_chunks()
                yield from _run(table.column(0).chunk(0), table.column(1).chunk(0))

        for batch in batches:
            n = batch.column(1).value_lengths().to_numpy()
            start = 0
            for i in range(batch.num_rows):
                if tokens and (tokens + n[i] > RUN_TOKENS or rows == RUN_CONTENTS):
                    held.append(batch.slice(start, i - start))
                    yield from flush()
                    held, tokens, rows, start = [], 0, 0, i
                tokens, rows = tokens + int(n[i]), rows + 1
            held.append(batch.slice(start))
        if tokens:
            yield from flush()

    toks = contents.select("content_hash", text.tokens(F.col("content")).alias("toks")).where(F.size("toks") > 0)
    return toks.mapInArrow(run, "term string, content_hash string, at array<int>")


def postings_search(posts: DataFrame, scope: DataFrame, query: str, k: int, unicode_clean: bool = False) -> DataFrame:
    """text_search by postings; scope: the content hashes to look among.

    Postings are sorted by term in runs, so the terms' own row groups and pages are read.
    """
    terms = text.query_terms(query, unicode_clean)
    if not terms:
        return scope.select(F.col("content_hash").alias("id"), F.lit(0.0).alias("score")).limit(0)
    held = posts.where(F.col("term").isin(*terms)).join(scope.select("content_hash"), "content_hash", "left_semi")
    of = [F.max(F.when(F.col("term") == t, F.col("at"))).alias(f"p{i}") for i, t in enumerate(terms)]
    every = held.groupBy(F.col("content_hash").alias("id")).agg(F.count("*").alias("n"), *of).where(F.col("n") == len(terms))
    score = F.round(text.rank([F.col(f"p{i}") for i in range(len(terms))]), 6)
    return every.select("id", score.alias("score")).orderBy(F.desc_nulls_last("score"), "id").limit(k)


def vector_search(contents: DataFrame, query: list[float], k: int, column: str = "embedding") -> DataFrame:
    """(id, score) of the k nearest contents by cosine."""
    return vector.topk(contents, "content_hash", column, query, k).withColumnRenamed("content_hash", "id")


def occurrences(chunks: DataFrame, scope: Scope) -> DataFrame:
    """One occurrence a content hash in scope: the first by path, ordinal, id."""
    order = F.struct("path", "ordinal", "id")
    rows = scope.of(chunks)
    return rows.groupBy("chunk_content_hash").agg(F.min_by(F.struct(*[c for c in chunks.columns]), order).alias("o")).select("o.*")


@dataclass
class Options:
    weights: dict[str, float] | None = None
    k: int = K
    retrieve: int = RETRIEVE
    final: int = FINAL
    use_summary: bool = False
    unicode_clean: bool = False
    reranker: Reranker = field(default_factory=Passthrough)


def summaries_exist(chunks: DataFrame, contents: DataFrame, scope: Scope) -> bool:
    """Some content in scope has a summary embedding."""
    held = contents.where(F.col("summary_embedding").isNotNull()).select("content_hash")
    return not held.join(scope_hashes(chunks, scope), "content_hash", "left_semi").limit(1).isEmpty()


def summaries_by(chunks: DataFrame, contents: DataFrame, views: DataFrame, key: str) -> DataFrame:
    """(key, three_way) for many scopes in one job: whether some content of the views (id, key) has a summary embedding."""
    of = views.select(F.col("id").alias("source_view_id"), key)
    held = contents.select(F.col("content_hash").alias("chunk_content_hash"), F.col("summary_embedding").isNotNull().alias("has")).where("has")
    found = chunks.select("source_view_id", "chunk_content_hash").join(held, "chunk_content_hash", "left_semi").select("source_view_id").distinct()
    return of.join(found.withColumn("has", F.lit(True)), "source_view_id", "left").groupBy(key).agg(F.max(F.coalesce("has", F.lit(False))).alias("three_way"))


def candidates(chunks: DataFrame, contents: DataFrame, query: str, query_vector: list[float], scope: Scope, options: Options, three_way: bool, posts: DataFrame | None = None, near=None) -> DataFrame:
    """(id, fused, text_score, vector_score[, summary_score]) of the content hashes to hydrate, ranked after scoping.

    Search is exact within the scope: contents are semi-joined with it first, at any size. posts: the contents'
    postings, so their texts aren't read; near(hashes, k): the vector channel from an approximate index, None if it has none.
    """
    hashes = scope_hashes(chunks, scope)
    inside = contents.join(hashes, "content_hash", "left_semi")
    by_text = text_search(inside, query, options.retrieve, options.unicode_clean) if posts is None else postings_search(posts, hashes, query, options.retrieve, options.unicode_clean)
    by_vector = near(hashes, options.retrieve) if near else None
    channels = {"text": by_text, "vector": vector_search(inside, query_vector, options.retrieve) if by_vector is None else by_vector}
    if three_way:
        channels["summary"] = vector_search(inside, query_vector, options.retrieve, "summary_embedding")
    weights = options.weights or (WEIGHTS_3 if three_way else WEIGHTS_2)
    return best(fused(channels, weights, options.k), options.retrieve)


def hydrated(found: DataFrame, chunks: DataFrame, contents: DataFrame, sources: DataFrame, views: DataFrame, scope: Scope) -> DataFrame:
    """Candidates with their occurrence, content and source, and their place from 1."""
    place = F.row_number().over(Window.orderBy(F.desc("fused"), "id"))
    top = F.broadcast(found.withColumn("place", place))  # RETRIEVE rows at most
    mine = chunks.join(top.select(F.col("id").alias("chunk_content_hash")), "chunk_content_hash", "left_semi")
    at = occurrences(mine, scope)
    names = views.join(sources, views["source_id"] == sources["id"]).select(views["id"].alias("source_view_id"), sources["name"].alias("source_name"), sources["id"].alias("source_id"))
    rows = top.join(at, top["id"] == at["chunk_content_hash"]).select(top["*"], *[at[c] for c in at.columns if c != "id"], at["id"].alias("chunk_id"))
    rows = rows.join(contents.select(F.col("content_hash").alias("chunk_content_hash"), "content"), "chunk_content_hash")
    return rows.join(names, "source_view_id", "left")


def shaped(rows: DataFrame, three_way: bool) -> DataFrame:
    """The results' columns: identity, snippet, coordinates, and the scores that exist."""
    score = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("double")
    return rows.select(
        "chunk_id", "place", F.col("path"), F.coalesce("source_name", F.lit("unknown")).alias("source_name"), "source_type", scalar.snippet(F.col("content")).alias("snippet"),
        F.struct("path", "start_line", "end_line", "header_path", "ordinal").alias("coordinates"),
        F.struct(F.col("fused"), score("text_score").alias("text"), score("vector_score").alias("vector"), (score("summary_score") if three_way else F.lit(None).cast("double")).alias("summary"), F.col("rerank_score").alias("rerank")).alias("scores"),
    )


def mode_of(n_hashes: F.Column, three_way: F.Column) -> F.Column:
    """mode, as a column."""
    size = F.when(n_hashes == 0, "empty").when(n_hashes < NARROW, "narrow").otherwise("broad")
    return F.concat(size, F.when(three_way & (n_hashes > 0), "+summary").otherwise(""))


def mode(n_hashes: int, three_way: bool) -> str:
    """How the scope counts: empty, narrow or broad, and whether summaries take part."""
    return "empty" if not n_hashes else ("narrow" if n_hashes < NARROW else "broad") + "+summary" * three_way


def search(tables: dict[str, DataFrame], query: str, query_vector: list[float], scope: Scope | None = None, options: Options | None = None, posts: DataFrame | None = None, near=None) -> DataFrame:
    """The results of one query, best first by place."""
    scope, options = scope or Scope(), options or Options()
    three_way = options.use_summary and summaries_exist(tables["chunks"], tables["chunk_contents"], scope)
    found = candidates(tables["chunks"], tables["chunk_contents"], query, query_vector, scope, options, three_way, posts, near)
    rows = hydrated(found, tables["chunks"], tables["chunk_contents"], tables["sources"], tables["source_views"], scope)
    return shaped(options.reranker.rerank(query, rows, options.final), three_way)


SCOPE = "scope int, branch string, source_name string, source_type string, path_prefix string"


def scoped(definitions: DataFrame, sources: DataFrame, views: DataFrame, chunks: DataFrame) -> DataFrame:
    """(scope, content_hash, at): the contents of scopes (SCOPE; null is no restriction), each with its first occurrence.

    A scope without a branch has its sources' active views, one with a branch the views of that name. All scopes are
    found by one join of the views and one of the chunks.
    """
    d = definitions.select("scope", "branch", F.col("source_name").alias("_name"), F.col("source_type").alias("_type"), "path_prefix")
    v = views.join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), "active_view_id"), "source_id")
    on = (F.col("_name").isNull() | (F.col("_name") == F.col("source_name"))) & F.when(F.col("branch").isNull(), F.col("id") == F.col("active_view_id")).otherwise((F.col("view_kind") == "branch") & (F.col("ref_name") == F.col("branch")))
    mine = v.join(F.broadcast(d), on).select("scope", "_type", "path_prefix", "source_name", F.col("id").alias("source_view_id"))
    c = chunks.select("source_view_id", "chunk_content_hash", "path", "ordinal", "id", "source_type", "start_line", "end_line")
    rows = c.join(mine, "source_view_id").where((F.col("_type").isNull() | (F.col("_type") == F.col("source_type"))) & (F.col("path_prefix").isNull() | F.col("path").startswith(F.col("path_prefix"))))
    at = F.min(F.struct("path", "ordinal", "id", "source_name", "start_line", "end_line")).alias("at")
    return rows.groupBy("scope", F.col("chunk_content_hash").alias("content_hash")).agg(at)


#: Rows of a side that is sent to every executor; a longer one is shuffled.
SENT = 200_000


def _few(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has SENT rows at most, else as it is."""
    return F.broadcast(df) if df.limit(SENT + 1).count() <= SENT else df


def search_batch(contents: DataFrame, queries: DataFrame, k: int = RETRIEVE, weights: dict[str, float] | None = None, posts: DataFrame | None = None, inside: DataFrame | None = None) -> DataFrame:
    """(query_id, id, fused, text_score, vector_score, rank) for queries (query_id, query, embedding[, scope]), all in one job.

    Text: the postings, the stored ones (posts) or those of the contents, made in the row, give each query the contents
    that hold its rarest term; only the postings of these contents are brought together, and those that hold all terms
    are ranked. Vectors: topk_batch. inside: (scope, content_hash) that a query's scope (a number from 0)
    lets it find; both channels are ranked after it.
    """
    of_scope = ["scope"] if inside is not None else []
    asked = queries.select("query_id", *of_scope, text.query_terms_column(F.col("query")).alias("terms")).where(F.size("terms") > 0).distinct()
    terms = asked.select("query_id", F.explode("terms").alias("term")).distinct()
    posts = (postings(contents.select("content_hash", "content")) if posts is None else posts).select("term", F.col("content_hash").alias("id"), "at")
    mine = posts.join(_few(terms.select("term").distinct()), "term", "left_semi")
    often = terms.join(_few(mine.groupBy("term").agg(F.count("*").alias("often"))), "term", "left")
    rarest = often.groupBy("query_id").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "term")).alias("of")).select("query_id", "of.term")
    maybe = posts.select("term", "id").join(_few(rarest), "term").select("query_id", "id")
    if inside is not None:
        maybe = maybe.join(_few(asked.select("query_id", "scope")), "query_id").join(inside.select("scope", F.col("content_hash").alias("id")), ["scope", "id"], "left_semi").select("query_id", "id")
    texts = mine.join(_few(maybe.select("id").distinct()), "id", "left_semi").groupBy("id").agg(F.collect_list(F.struct("term", "at")).alias("all"))
    held = F.sort_array(F.filter("all", lambda x: F.array_contains("terms", x["term"])))
    hits = maybe.join(texts, "id").join(_few(asked.select("query_id", "terms")), "query_id").select("query_id", "id", F.size("terms").alias("n"), held.alias("held")).where(F.size("held") == F.col("n"))
    one = F.aggregate(F.sequence(F.lit(1), F.size(F.col("held")[0]["at"])), F.lit(0.0), lambda a, j: a + F.lit(1.0) / (j * j)) * text.WEIGHT / text.ONE_TERM
    none = F.struct(F.lit(0.0).alias("miss"), F.expr("cast(array() as array<int>)").alias("seen"))
    step = lambda s, h: F.struct((s["miss"] + text.pair_misses(h["at"], s["seen"], text.log_misses())).alias("miss"), F.concat(s["seen"], h["at"]).alias("seen"))
    across = F.aggregate("held", none, step, lambda s: 1 - F.exp(s["miss"]))
    scored = hits.select("query_id", "id", F.round(F.when(F.col("n") == 1, one).otherwise(across), 6).alias("score"))
    top = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    by_text = scored.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k).drop("r")
    vectors = contents.select(F.col("content_hash").alias("id"), "embedding").where("embedding is not null")
    if inside is not None:
        vectors = vectors.join(inside.groupBy(F.col("content_hash").alias("id")).agg(F.collect_set("scope").alias("scope")), "id")
    by_vector = vector.topk_batch(vectors, "id", "embedding", queries, "query_id", "embedding", k, scopes="scope" if inside is not None else None)
    both = fused({"text": by_text, "vector": by_vector}, weights or WEIGHTS_2, by=("query_id",))
    place = Window.partitionBy("query_id").orderBy(F.desc("fused"), "id")
    return both.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
