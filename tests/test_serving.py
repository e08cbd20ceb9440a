"""Providers, the tool server, the approximate index, SQL statements."""

import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseek import server
from lodeseek.engine import Engine
from lodeseek.functions import vector
from lodeseek.operators import ivf
from lodeseek.sources import archive, config, providers


def test_retries():
    waits, left = [], [429, 503, 500]

    def call():
        if left:
            raise providers.ProviderError(left.pop(0))
        return "ok"

    assert providers.retrying(call, 4, 2.0, waits.append) == "ok" and waits == [2.0, 4.0, 8.0]
    with pytest.raises(providers.ProviderError):
        providers.retrying(lambda: (_ for _ in ()).throw(providers.ProviderError(400)), 4, 0, waits.append)
    assert providers.in_order(lambda x: x * 2, [3, 1, 2], 3) == [6, 2, 4]


def test_pace_is_shared():
    now, waits = [0.0], []

    def sleep(s):
        waits.append(s)
        now[0] += s

    pace, left = providers.Pace(lambda: now[0], sleep), [429, 429, 503]

    def call():
        if left:
            raise providers.ProviderError(left.pop(0))
        return now[0]

    own = []
    assert providers.retrying(call, 4, 2.0, own.append, pace) == 6.0 and waits == [2.0, 4.0] and own == [8.0]
    pace.hold(3.0)
    pace.hold(1.0)  # a shorter wait takes nothing from a longer one
    assert providers.retrying(call, 1, 2.0, own.append, pace) == 9.0 and waits[-1] == 3.0  # another request waits too
    assert providers.pace_of("u") is providers.pace_of("u") and providers.pace_of("u") is not providers.pace_of("v")


def test_remote_embeddings():
    def transport(url, headers, body):
        assert headers["Authorization"] == "Bearer k"
        return 200, {"data": [{"index": i, "embedding": [float(i), 0.0]} for i in reversed(range(len(body["input"])))]}

    e = providers.RemoteEmbeddings("u", "m", 2, "k", transport)
    assert len(e(["t"] * 65)) == 65 and e(["a", "b"]) == [[0.0, 0.0], [1.0, 0.0]]
    with pytest.raises(providers.ProviderError):
        providers.RemoteEmbeddings("u", "m", 3, "k", transport)(["a"])


def test_remote_reranker_and_completions(spark):
    d = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "place int, content string")
    r = providers.RemoteReranker("u", "m", transport=lambda u, h, b: (200, {"results": [{"index": 2, "relevance_score": 0.9}, {"index": 0, "relevance_score": 0.5}]}))
    assert [(x.content, x.rerank_score) for x in r.rerank("q", d, 2).collect()] == [("c", 0.9), ("a", 0.5)]
    good = providers.RemoteCompletions("u", "m", "s", transport=lambda u, h, b: (200, {"choices": [{"message": {"content": " " + b["messages"][1]["content"]}}]}))
    assert good(["x", "y"]) == ["x", "y"]
    assert providers.RemoteCompletions("u", "m", "s", transport=lambda u, h, b: (401, {}))(["x"]) == [None]


def fake_server():
    """A transport, made here so that it is sent to the workers by value."""

    def fake(url, headers, body):
        """A server of embeddings, ranks and completions; refuses texts with `refuse`."""
        assert headers == {"Authorization": "Bearer k"}
        if url == "http://e":
            if any("refuse" in x for x in body["input"]):
                return 400, {}
            way = 1.0 if body["task"] == "q" else 0.5
            return 200, {"data": [{"index": i, "embedding": [way, float("gamma" in x), 1.0]} for i, x in enumerate(body["input"])]}
        if url == "http://r":
            assert all(set(d) == {"text"} for d in body["documents"])
            return 200, {"results": [{"index": i, "relevance_score": float(len(d["text"]))} for i, d in enumerate(body["documents"])][: body["top_n"]]}
        assert body["messages"][0]["content"] == providers.SYSTEM and body["temperature"] == 0.2 and body["max_tokens"] == 300
        return 200, {"choices": [{"message": {"content": "about " + body["messages"][1]["content"][-12:]}}]}

    return fake


def test_models_from_the_configuration(spark, tmp_path, monkeypatch):
    remote = lambda x, **more: {"provider": "remote", "url": f"http://{x}", "model": "m", "apiKey": "k", "retryDelay": 0.0, **more}
    c = {"embeddings": remote("e", dimensions=3, batch=1, passage={"task": "p"}, query={"task": "q"}), "reranker": remote("r", documents="object"), "summarization": remote("c", enabled=True)}
    full, fake = config.checked(config.merged(config.DEFAULTS, c)), fake_server()
    made = {"embedder": providers.embedder_of(full["embeddings"], fake), "reranker": providers.reranker_of(full["reranker"], fake), "summarizer": providers.summarizer_of(full["summarization"], fake)}
    e = Engine(spark, str(tmp_path), c, **made)
    files = [("a.txt", "alpha"), ("g.txt", "gamma " * 50), ("x.txt", "refuse this")]
    got = e.index_documents("docs", spark.createDataFrame(files, "path string, content string"))
    assert got["deferred"] == 1 and e.embedder.query("gamma") == [1.0, 1.0, 1.0]
    assert [r.path for r in e.search("gamma").orderBy("place").collect()][0] in ("a.txt", "g.txt") and e.search("gamma").agg(F.max("scores.rerank")).first()[0] == 300.0
    assert e.summarize() == {"summarized": 1, "skipped": 2}
    plain = Engine(spark, str(tmp_path), {"embeddings": remote("e", dimensions=3), "reranker": remote("r"), "summarization": remote("c", enabled=True)})
    assert isinstance(plain.reranker, providers.RemoteReranker) and plain.embedder.embed_many.url == "http://e" and plain.summarizer.complete.url == "http://c"
    for wrong in ({"embeddings": {"provider": "no"}}, {"reranker": {"provider": "remote"}}, {"summarization": {"provider": "remote", "url": "u"}}, {"embeddings": {"dimensions": 0}}):
        with pytest.raises(ValueError):
            Engine(spark, str(tmp_path), wrong)


def test_server(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.index_documents("docs", spark.createDataFrame([("a.txt", "alpha beta")], "path string, content string"))
    call = lambda i, name, **a: json.dumps({"jsonrpc": "2.0", "id": i, "method": "tools/call", "params": {"name": name, "arguments": a}})
    lines = [json.dumps({"jsonrpc": "2.0", "id": 0, "method": "initialize"}), json.dumps({"jsonrpc": "2.0", "method": "notifications/initialized"}), json.dumps({"jsonrpc": "2.0", "id": 1, "method": "tools/list"})]
    lines += [call(2, "search", query="alpha"), call(3, "search"), call(4, "status"), call(5, "list_sources"), call(6, "read_source", path="a.txt"), call(7, "search", query="x", topK=101), "{", json.dumps({"id": 8, "method": "no"})]
    out = io.StringIO()
    server.serve(e, io.StringIO("\n".join(lines) + "\n"), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [g["id"] for g in got] == [0, 1, 2, 3, 4, 5, 6, 7, None, 8] and len(got[1]["result"]["tools"]) == 4
    text = lambda g: json.loads(g["result"]["content"][0]["text"])
    assert text(got[2])[0]["path"] == "a.txt" and text(got[4])["files"] == 1 and text(got[5])[0]["name"] == "docs" and text(got[6])["content"] == "alpha beta"
    assert got[3]["result"]["isError"] and got[7]["result"]["isError"] and got[8]["error"] and got[9]["error"]


def test_approximate_index(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    model = ivf.fitted(e, "vec_id", "embedding", 8)
    assert np.allclose(np.linalg.norm(model.arrays()[0], axis=1), 1) and ivf.Model.of(model.held()) == model
    ivf.coded(e, "vec_id", "embedding", model).write.parquet(str(tmp_path / "ivf"))
    index = spark.read.parquet(str(tmp_path / "ivf"))
    exact = vector.topk_batch(e, "vec_id", "embedding", q, "query_id", "embedding", 10)
    assert index.count() == e.count() and index.where("length(code) <> 8").isEmpty()
    got = ivf.calibrated(index, e, q, "query_id", "embedding", "vec_id", "embedding", model, 10, 0.9)
    assert got.recall >= 0.9 and got.probes <= 8
    asked = [tuple(r) for r in q.collect()]
    found = lambda probes: ivf.search(index, asked, "vec_id", "embedding", got, 10, probes, "long")
    assert ivf.recall(found(None), exact, "query_id", "vec_id") == got.recall
    assert ivf.recall(found(8), exact, "query_id", "vec_id") >= 0.99
    scores = {(r.query_id, r.vec_id): r.score for r in exact.collect()}
    assert all(scores.get((r.query_id, r.vec_id), r.score) == r.score for r in found(8).collect())  # short lists are scored exactly
    with pytest.raises(ValueError):
        ivf.search(index, asked * 100, "vec_id", "embedding", got, 10)


def test_statements():
    assert archive.statements("-- c\n\nINSERT 1;\nINSERT\n 2;\nrest") == ["INSERT 1;", "INSERT\n 2;", "rest"]
