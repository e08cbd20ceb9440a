"""Scalar functions, terms, ranks, vectors, fusion."""

import math

import pytest
from pyspark.sql import functions as F

from lodeseek.functions import scalar, text, vector
from lodeseek.operators import fusion


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_terms():
    assert text.query_terms("Foo-bar  baz_1 !!") == ["foobar", "baz_1"]
    assert text.query_terms("café") == ["caf"] and text.query_terms("café", True) == ["café"]
    assert text.query_terms("  ") == []
    assert text.query_terms("Привет мир") == ["привет", "мир"]


def test_rank_of_one_term(spark):
    toks = text.tokens(F.lit("a b a"))
    got = one(spark, text.rank([text.positions(toks, F.lit("a"))]))
    assert got == pytest.approx(0.1 * (1 + 1 / 4) / 1.64493406685)
    assert one(spark, text.rank([text.positions(toks, F.lit("zz"))])) is None


def test_rank_of_two_terms(spark):
    toks = text.tokens(F.lit("a b x a"))
    w = lambda d: 0.1 * math.sqrt(1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2)))
    got = one(spark, text.rank([text.positions(toks, F.lit("a")), text.positions(toks, F.lit("b"))]))
    assert got == pytest.approx(1 - (1 - w(1)) * (1 - w(2)))


def test_hash_vector(spark):
    v = vector.hash_vector("hello", 40)
    assert len(v) == 40 and sum(x * x for x in v) == pytest.approx(1) and v[0] == pytest.approx(v[32])
    assert one(spark, vector.hash_vector_column(F.lit("hello"), 40)) == pytest.approx(v, abs=1e-6)


def test_cosine(spark):
    assert one(spark, vector.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(1 / math.sqrt(2))
    assert one(spark, vector.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None


def test_fusion(spark):
    a = spark.createDataFrame([("a", 2.0), ("b", 1.0)], "id string, score double")
    b = spark.createDataFrame([("b", 9.0), ("a", 8.0), ("c", 1.0)], "id string, score double")
    got = {r.id: r for r in fusion.fused({"text": a, "vector": b}, {"text": 0.4, "vector": 0.6}).collect()}
    assert got["a"].fused == pytest.approx(0.4 / 61 + 0.6 / 62, abs=1e-9) and got["b"].fused == pytest.approx(0.4 / 62 + 0.6 / 61, abs=1e-9)
    assert got["c"].text_score is None and got["c"].vector_score == 1.0
    only = fusion.fused({"text": a, "vector": b}, {"text": 1.0, "vector": 0.0}).collect()
    assert {r.id for r in only} == {"a", "b"}
    assert fusion.fused({"text": a.limit(0)}, {"text": 1.0}).count() == 0
    assert [r.id for r in fusion.best(fusion.fused({"text": a}, {"text": 1.0}), 1).collect()] == ["a"]


def test_topk_batch_is_topk(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    q = e.where("vec_id in (3, 4)").select(F.col("vec_id").alias("q"), "embedding")
    got = {(r.q, r.vec_id): r.score for r in vector.topk_batch(e, "vec_id", "embedding", q, "q", "embedding", 5, block=1).collect()}
    for i in (3, 4):
        v = list(e.where(F.col("vec_id") == i).first().embedding)
        assert {(i, r.vec_id): r.score for r in vector.topk(e, "vec_id", "embedding", v, 5).collect()} == pytest.approx({k: s for k, s in got.items() if k[0] == i}, abs=2e-6)


def test_gates_and_placeholders(spark):
    gate = lambda t, k: one(spark, scalar.gate(F.lit(t), F.lit(k)))
    assert gate("x" * 199, "TYPE") == "content<200"
    assert gate("x" * 200, "Interface") == "interface-without-docstring"
    assert gate("/** d */" + "x" * 200, "type") is None and gate("x" * 200, "CLASS") is None
    assert one(spark, scalar.skipped(F.lit("r"))) == "[skipped:r]" and one(spark, scalar.failed(F.lit("r"))) == "[failed:r]"


def test_prompt(spark):
    assert one(spark, scalar.prompt(F.lit("p"), F.lit("k"), F.lit("c"), F.lit(None).cast("string"), F.lit("java"))) == "Path: p\nKind: k\nLanguage: java\n---\nc"


def test_fingerprint(spark):
    f = lambda d, t: one(spark, scalar.fingerprint(F.lit(d), F.lit(t).cast("string"), F.lit("m")))
    assert (f(False, "o"), f(True, "o"), f(True, None)) == ("tree:o", "dirty:o:m", "workspace:m")


@pytest.mark.parametrize("start,end,context,want", [(2, 3, 0, (2, 3, "b\nc")), (2, 3, 5, (1, 4, "a\nb\nc\nd")), (2, None, 0, (2, 2, "b")), (None, None, 0, (1, 4, "a\nb\nc\nd")), (9, 12, 0, (9, 4, ""))])
def test_fragment(spark, start, end, context, want):
    got = scalar.fragment(F.lit("a\nb\nc\nd"), F.lit(start).cast("int"), F.lit(end).cast("int"), F.lit(context))
    r = spark.range(1).select(*[c.alias(n) for c, n in zip(got, "abc")]).first()
    assert tuple(r) == want


def test_small_helpers(spark):
    assert scalar.format_cost(0.0012) == "$1.20m" and scalar.format_cost(0.5) == "$0.500" and scalar.js_round(2.5) == 3
    assert one(spark, scalar.normal_path(F.lit("./a\\b"))) == "a/b" and one(spark, scalar.extension(F.lit("a/B.TS"))) == ".ts"
    d = spark.createDataFrame([("it's\n", None, [1.0, 2.0], True)], "a string, b int, v array<float>, t boolean")
    assert d.select(scalar.insert_text("x", dict(d.dtypes))).first()[0] == "INSERT INTO x (a, b, v, t) VALUES (E'it''s\\n', NULL, '[1.0,2.0]'::vector, TRUE);"
