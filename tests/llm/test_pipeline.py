"""The pipeline's stages against what brute force leaves, and its run."""

import collections

import brute
import corpus_pipeline
from pyspark.sql import functions as F
from test_operators import odd, odd_columns  # noqa: F401  a fixture


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "mixing", "token_ids"]

    kept = stages["quality_rules"](spark, docs, sf)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == columns and not any(brute.base_quality(rows[i].text)["base_failed"] for i in ids)

    once = stages["near_dedup"](spark, kept, sf)
    left = {r.doc_id for r in once.collect()}
    assert once.columns == columns and left == {i for i, (_, c) in brute.components({i: rows[i].text for i in ids}).items() if i == c}

    pure = stages["decontamination"](spark, once, sf)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {i for i, w in brute.contamination({i: rows[i].text for i in left}, bench).items() if not w["contaminated"]}
    assert pure.columns == columns and {r.doc_id for r in pure.collect()} == clean

    mixed = stages["mixing"](spark, pure, sf)
    copies = collections.Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == columns and set(copies) <= clean and max(copies.values()) <= 2

    out = stages["token_ids"](spark, mixed, sf)
    assert sum(copies.values()) == out.count() and {r.doc_id for r in out.collect()} == set(copies)


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    last = out.orderBy(F.desc("start")).first()
    assert last.start + last.n_tokens == out.agg(F.sum("n_tokens")).first()[0]


def test_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_odd_table(spark, sf, odd, tmp_path):  # noqa: F811
    """Nulls, empty and very long texts, ties, repeated rows and clashing names through every stage, each on what brute force leaves."""
    df, rows = odd
    prose = [(100 + i, f"w{i} " + " ".join(f"v{(i * 37 + k * k) % 997}" for k in range(80 + i)), "en", "s", i) for i in range(12)]
    more = odd_columns(spark.createDataFrame(prose + [prose[0], prose[1]], "doc_id long, text string, lang string, source string, n_chars long"))
    docs, stages = df.unionByName(more), dict(corpus_pipeline.STAGES)
    texts = [(r["doc_id"], r["text"]) for r in rows] + [(p[0], p[1]) for p in (*prose, prose[0], prose[1])]

    good = collections.Counter(i for i, t in texts if not brute.base_quality(t)["base_failed"])
    kept = stages["quality_rules"](spark, docs, sf)
    got = collections.Counter(r.doc_id for r in kept.collect())
    assert kept.columns == docs.columns and not got - good and got[100] == 2 and got[4] == got[5] == got[6] == 0

    once = stages["near_dedup"](spark, docs, sf)
    groups = brute.components({i: t for i, t in texts if i is not None})
    assert once.columns == docs.columns and collections.Counter(r.doc_id for r in once.collect()) == collections.Counter(i for i, _ in texts if i is None or groups[i][1] == i)

    pure = stages["decontamination"](spark, docs, sf)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = brute.contamination(dict(enumerate(t for _, t in texts)), bench)
    assert pure.columns == docs.columns and pure.count() == sum(not w["contaminated"] for w in clean.values())

    mixed = stages["mixing"](spark, docs, sf)
    copies = collections.Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns and all(n <= 2 * sum(j == i for j, _ in texts) for i, n in copies.items()) and copies[100] % 2 == 0
    assert copies == collections.Counter(r.doc_id for r in stages["mixing"](spark, docs, sf).collect())

    out = stages["token_ids"](spark, docs, sf).orderBy("start").collect()
    assert [r.doc_id for r in out] == sorted((i for i, _ in texts), key=lambda i: (i is not None, i or 0)) and sum(r.n_tokens for r in out[:-1]) == out[-1].start

    for name, stage in corpus_pipeline.STAGES:  # one after another, as run() does
        path = str(tmp_path / name)
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and docs.count() > 0
