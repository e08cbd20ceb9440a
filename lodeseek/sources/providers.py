"""Remote models behind the engine's protocols: retries, ordered concurrency, embeddings, reranking, completions.

Transport is a function (url, headers, body) -> (status, body), so nothing here needs a network to be tested.
"""

from __future__ import annotations

import json
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Transport = Callable[[str, dict, dict], tuple[int, dict]]
BATCH, TEMPERATURE, MAX_TOKENS = 64, 0.2, 300
#: What a summarising model is told when the configuration says nothing else.
SYSTEM = (
    "You describe one piece of source code or documentation, so that a developer's question in plain words can find it. Answer in English with one paragraph of "
    "60 to 120 words: what the piece does, and which part it plays around it. Name no interface, argument, result or behaviour that the text doesn't show, and don't quote code."
)


class ProviderError(RuntimeError):
    def __init__(self, status: int, message: str = ""):
        super().__init__(f"status {status} {message}".strip())
        self.status = status


def post(url: str, headers: dict, body: dict) -> tuple[int, dict]:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=60) as r:
            return r.status, json.load(r)
    except urllib.error.HTTPError as e:
        return e.code, {}


def wait_before(status: int, attempt: int, base: float) -> float | None:
    """Seconds before the next attempt: linear after 429, doubling after a server's error, None for no further one."""
    if status == 429:
        return base * attempt
    return base * 2 ** (attempt - 1) if status >= 500 else None


class Pace:
    """When requests to one place may go on: a refusal for their rate (429) holds back all that a process sends there."""

    def __init__(self, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.clock, self.sleep, self.lock, self.free = clock, sleep, threading.Lock(), 0.0

    def enter(self) -> None:
        while (left := self.free - self.clock()) > 0:
            self.sleep(left)

    def hold(self, seconds: float) -> None:
        with self.lock:
            self.free = max(self.free, self.clock() + seconds)


_PACES: dict[str, Pace] = {}


def pace_of(url: str) -> Pace:
    """The process's pace for a URL."""
    return _PACES.setdefault(url, Pace())


def retrying(call: Callable, attempts: int = 3, base: float = 1.0, sleep: Callable[[float], None] = time.sleep, pace: Pace | None = None):
    """call(), again after a ProviderError that allows it; with a pace, a wait after 429 is one of all its callers."""
    for attempt in range(1, attempts + 1):
        try:
            if pace:
                pace.enter()
            return call()
        except ProviderError as e:
            wait = wait_before(e.status, attempt, base)
            if pace and e.status == 429:
                pace.hold(wait)
            if wait is None or attempt == attempts:
                raise
            if not pace or e.status != 429:
                sleep(wait)


def in_order(f: Callable, items: list, at_once: int) -> list:
    """f of all items, some at a time, results in the items' order."""
    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(f, items))


def _asked(transport: Transport, url: str, key: str | None, body: dict, attempts: int, base: float) -> dict:
    def call() -> dict:
        status, answer = transport(url, {"Authorization": f"Bearer {key}"} if key else {}, body)
        if status != 200:
            raise ProviderError(status)
        return answer

    return retrying(call, attempts, base, pace=pace_of(url))


class RemoteEmbeddings:
    """embed_many for indexing.BatchEmbedder: batches of BATCH texts, vectors in the order of the texts, shapes checked."""

    def __init__(self, url: str, model: str, dimensions: int, key: str | None = None, transport: Transport = post, attempts: int = 3, base: float = 1.0, more: dict | None = None):
        self.url, self.model, self.dimensions, self.key, self.transport, self.attempts, self.base, self.more = url, model, dimensions, key, transport, attempts, base, more or {}

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for i in range(0, len(texts), BATCH):
            part = texts[i : i + BATCH]
            answer = _asked(self.transport, self.url, self.key, {"model": self.model, "input": part, "dimensions": self.dimensions} | self.more, self.attempts, self.base)
            rows = sorted(answer.get("data") or [], key=lambda r: r["index"])
            if len(rows) != len(part) or any(len(r["embedding"]) != self.dimensions for r in rows):
                raise ProviderError(200, "wrong number or size of vectors")
            out += [r["embedding"] for r in rows]
        return out


class RemoteReranker:
    """Reranks the candidates of one query (retrieveTopK rows at most) by a remote model's scores."""

    def __init__(self, url: str, model: str, key: str | None = None, transport: Transport = post, attempts: int = 3, base: float = 1.0, as_objects: bool = False):
        self.url, self.model, self.key, self.transport, self.attempts, self.base, self.as_objects = url, model, key, transport, attempts, base, as_objects

    def rerank(self, query: str, candidates: DataFrame, n: int) -> DataFrame:
        rows = candidates.select("place", "content").orderBy("place").collect()
        if not rows:
            return candidates.withColumn("rerank_score", F.lit(None).cast("double"))
        answer = _asked(self.transport, self.url, self.key, {"model": self.model, "query": query, "documents": [{"text": r.content} if self.as_objects else r.content for r in rows], "top_n": n}, self.attempts, self.base)
        scores = candidates.sparkSession.createDataFrame([(rows[r["index"]].place, float(r["relevance_score"])) for r in answer["results"]], "place int, rerank_score double")
        return candidates.join(scores, "place").orderBy(F.desc("rerank_score"), "place").limit(n)


class RemoteCompletions:
    """complete(prompts) for summarize.PromptSummarizer; None where the model fails."""

    def __init__(self, url: str, model: str, system: str, key: str | None = None, transport: Transport = post, at_once: int = 4, attempts: int = 3, base: float = 1.0):
        self.url, self.model, self.system, self.key, self.transport, self.at_once, self.attempts, self.base = url, model, system, key, transport, at_once, attempts, base

    def one(self, prompt: str) -> str | None:
        body = {"model": self.model, "temperature": TEMPERATURE, "max_tokens": MAX_TOKENS, "messages": [{"role": "system", "content": self.system}, {"role": "user", "content": prompt}]}
        try:
            answer = _asked(self.transport, self.url, self.key, body, self.attempts, self.base)
            return (answer["choices"][0]["message"]["content"] or "").strip() or None
        except (ProviderError, KeyError, IndexError):
            return None

    def __call__(self, prompts: list[str]) -> list[str | None]:
        return in_order(self.one, prompts, self.at_once)


def embedder_of(c: dict, transport: Transport = post):
    """The embedder of the configuration's `embeddings`: `hash`, or `remote` with url, model, dimensions, apiKey.

    passage and query: further fields of the request for contents and for queries (a task's name, say).
    """
    from ..operators.indexing import BatchEmbedder, HashEmbedder

    if c["provider"] == "hash":
        return HashEmbedder(c["dimensions"])
    made = lambda more: RemoteEmbeddings(c["url"], c["model"], c["dimensions"], c.get("apiKey"), transport, c.get("attempts", 3), c.get("retryDelay", 1.0), more)
    return BatchEmbedder(made(c.get("passage")), c["dimensions"], c.get("batch", 32), made(c.get("query")), c.get("concurrency", 3))


def reranker_of(c: dict, transport: Transport = post):
    """The reranker of the configuration's `reranker`: `none`, or `remote` with url, model, apiKey; documents: `string` or `object`."""
    from ..operators.search import Passthrough

    if c["provider"] == "none":
        return Passthrough()
    return RemoteReranker(c["url"], c["model"], c.get("apiKey"), transport, c.get("attempts", 3), c.get("retryDelay", 1.0), c.get("documents", "string") == "object")


def summarizer_of(c: dict, transport: Transport = post):
    """The summariser of the configuration's `summarization`: `mock`, or `remote` with url, model, apiKey and system."""
    from ..operators.summarize import MockSummarizer, PromptSummarizer

    if c["provider"] == "mock":
        return MockSummarizer()
    return PromptSummarizer(RemoteCompletions(c["url"], c["model"], c.get("system", SYSTEM), c.get("apiKey"), transport, c.get("concurrency", 4), c.get("attempts", 3), c.get("retryDelay", 1.0)))
