"""Repeats, alignment and hard negatives against brute force, and on tables with nulls, empties, ties and clashing names."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest
from brute import WORD
from pyspark.sql import functions as F

from lodeseek.llm import alignment, negatives, repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def clashing(df, *names):
    for c in (*names, "id", "key", "row", "kept", "n", "block", "a b", "p.q", "b`c"):
        df = df.withColumn(c, F.lit("clash"))
    return df


# --- 11 repeats ---


def brute_repeats(texts, length):
    """For each text (n_bytes, n_removed, n_spans, sha256 of what is left), every string looked at."""
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(x[i : i + length] for x in data for i in range(len(x) - length + 1))
    out = []
    for x in data:
        gone = np.zeros(len(x) + 1, np.int8)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = 1
        kept = bytes(b for b, g in zip(x, gone) if not g)
        out.append((len(x), int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def summed(df, **options):
    return sorted((r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in repeats.repeats(df, **options).collect())


def test_repeats(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    rows = d.select("doc_id", "text").collect()
    want = {r.doc_id: w for r, w in zip(rows, brute_repeats([r.text for r in rows], 400))}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.report(d).collect()}
    assert got == want and any(0 < w[1] < w[0] for w in want.values())


def repeating(seed, n):
    """Texts of a small alphabet with passages, near copies, periods and texts around the length."""
    rng = random.Random(seed)
    word = lambda k, of="abcdé ": "".join(rng.choice(of) for _ in range(k))
    shared = [word(rng.randrange(10, 120)) for _ in range(8)]
    out = ["a" * 150, "ab" * 70, "abc" * 50 + "x" + "abc" * 50, "a" * 29, "a" * 30, "a" * 31, None, "", word(30), word(29)]
    for _ in range(n):
        parts = [word(rng.randrange(0, 60)) if rng.random() < 0.5 else rng.choice(shared) for _ in range(rng.randrange(1, 8))]
        out.append("".join(parts))
        if rng.random() < 0.3:
            t = list(out[-1])
            if t:
                t[rng.randrange(len(t))] = "#"
            out.append("".join(t))
    return out + out[-5:]


@pytest.mark.parametrize("most,block,hot,stretch", [(4096, 4096, None, None), (2, 3, 5, None), (4096, 7, None, 64)])
def test_repeats_odd(spark, most, block, hot, stretch, monkeypatch):
    """Short strings and all sizes: in one block; with crowded grams, hot keys and no broadcast; in short stretches."""
    monkeypatch.setattr(repeats, "MOST", most)
    monkeypatch.setattr(repeats, "BLOCK", block)
    if hot:
        monkeypatch.setattr("lodeseek.llm.common.HOT_ROWS", hot)
        monkeypatch.setattr(repeats, "small", lambda df: df)
    if stretch:
        monkeypatch.setattr(repeats, "SLICE_BYTES", stretch)
        monkeypatch.setattr(repeats, "slices", lambda texts: __import__("lodeseek.llm.kernels", fromlist=["slices"]).slices(texts, stretch))
    texts = repeating(4, 150)
    d = spark.createDataFrame([(None if i % 50 == 3 else i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string")
    d = clashing(d, "spans", "start", "doc", "tag", "kept_sha256")
    assert summed(d, length=30, gram=9) == sorted(brute_repeats(texts, 30))
    if most == 4096:
        assert summed(d, length=7) == sorted(brute_repeats(texts, 7))
        assert repeats.report(d.limit(0)).count() == 0 and summed(d.where("text is null")) == [(0, 0, 0, hashlib.sha256(b"").hexdigest())]


def brute_passages(texts, length):
    """For each text the runs of words that repeated strings of so many words cover, every string looked at."""
    data = [WORD.findall(t or "") for t in texts]
    seen = collections.Counter(tuple(x[i : i + length]) for x in data for i in range(len(x) - length + 1))
    out = []
    for x in data:
        gone = np.zeros(len(x) + 1, np.int8)
        for i in range(len(x) - length + 1):
            if seen[tuple(x[i : i + length])] > 1:
                gone[i : i + length] = 1
        edge = np.flatnonzero(np.diff(gone, prepend=0))
        out.append(list(zip(edge[::2].tolist(), edge[1::2].tolist())))
    return out


def told(df, **options):
    return sorted((r.n_bytes, [tuple(x) for x in r.passages]) for r in repeats.repeats(df, **options).collect())


def test_repeated_passages_below_400_bytes(spark):
    """A passage of over 50 short words that two documents share has too few bytes for a span, but is told as a passage."""
    rng = random.Random(11)
    words = lambda n: [f"{rng.randrange(16**6):x}" for _ in range(n)]
    shared, short = words(52), words(49)
    texts = [" ".join(words(30) + shared + words(40)), " ".join(words(70)) + "\n" + "\t ".join(shared), " ".join(words(9) + short + words(9)), " ".join(short), " ".join(words(200)), "", None]
    assert len(" ".join(shared)) < 400
    got = sorted(repeats.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert [(r.n_removed, r.n_spans, r.n_passages, r.n_passage_words) for r in got] == [(0, 0, 1, 52), (0, 0, 1, 52), *[(0, 0, 0, 0)] * 5]


def test_passages(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    rows = d.select("doc_id", "text").collect()
    want = {r.doc_id: (len(w), sum(b - a for a, b in w)) for r, w in zip(rows, brute_passages([r.text for r in rows], 50))}
    got = {r.doc_id: (r.n_passages, r.n_passage_words) for r in repeats.report(d).collect()}
    assert got == want and any(w[0] for w in want.values())


@pytest.mark.parametrize("most,block,hot,stretch", [(4096, 4096, None, None), (2, 3, 5, None), (4096, 7, None, 64)])
def test_passages_odd(spark, most, block, hot, stretch, monkeypatch):
    """Strings of few words of a small vocabulary, with every kind of white space, as in test_repeats_odd."""
    monkeypatch.setattr(repeats, "MOST", most)
    monkeypatch.setattr(repeats, "BLOCK", block)
    if hot:
        monkeypatch.setattr("lodeseek.llm.common.HOT_ROWS", hot)
        monkeypatch.setattr(repeats, "small", lambda df: df)
    if stretch:
        monkeypatch.setattr(repeats, "SLICE_BYTES", stretch)
        monkeypatch.setattr(repeats, "slices", lambda texts: __import__("lodeseek.llm.kernels", fromlist=["slices"]).slices(texts, stretch))
    rng = random.Random(7)
    # More than END different words in a block, and words longer than a stretch.
    of = [*"abcé", "\u00a0x", "A"] + [f"w{k}" for k in range(400)] + ["long" * 40]
    word = lambda: rng.choice(of[:6]) if rng.random() < 0.6 else rng.choice(of)
    shared = [[word() for _ in range(rng.randrange(4, 40))] for _ in range(8)]
    texts = ["a " * 60, "a b " * 40, "a b c " * 20 + "x " + "a b c " * 20, "a " * 11, "a " * 12, " \n\t", None, ""]
    for _ in range(150):
        parts = [[word() for _ in range(rng.randrange(0, 20))] if rng.random() < 0.5 else rng.choice(shared) for _ in range(rng.randrange(1, 7))]
        texts.append("".join(w + rng.choice([" ", "\n", "\t ", "\x0b", "\r\n"]) for p in parts for w in p))
    texts += texts[-5:]
    d = spark.createDataFrame([(None if i % 50 == 3 else i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string")
    d = clashing(d, "spans", "passages", "start", "doc", "tag")
    want = sorted((len((t or "").encode()), w) for t, w in zip(texts, brute_passages(texts, 12)))
    assert told(d, length=30, gram=9, words=12) == want and sum(len(w) for _, w in want) > 50
    assert summed(d, length=30, gram=9) == sorted(brute_repeats(texts, 30))


def test_column_transform():
    """Orders and common prefixes of every column, against sorted suffixes."""
    rng = random.Random(1)
    rows = [[rng.choice((97, 98)) if 2 <= k < 30 - i % 5 else 256 for k in range(32)] for i in range(60)]
    group = np.sort(np.array([rng.randrange(4) for _ in rows]))
    matrix = np.array(rows, np.uint16)
    suffix = lambda i, t: [(x, 0) if x < 256 else (256, i) for x in rows[i][t:]]
    for t, order, common in repeats.columns(matrix, group):
        cut = lambda i: rows[i][t:]
        assert [(group[i], cut(i)) for i in order] == sorted((group[i], cut(i)) for i in range(60))
        for k in range(1, 60):
            a, b = suffix(order[k - 1], t), suffix(order[k], t)
            n = next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
            assert common[k] == (n if group[order[k]] == group[order[k - 1]] else 0)


def test_least():
    x = np.random.default_rng(3).integers(0, 50, 1000).astype(np.uint64)
    for w in (1, 2, 7, 999, 1000):
        assert (repeats.least(x, w) == [x[i : i + w].min() for i in range(1001 - w)]).all()


# --- 12 alignment ---


def brute_alignment(texts):
    """Of (row, text): the contract's columns by row, token by token."""
    p = alignment.pair(alignment.tokenizer_file(), alignment.pieces_file())
    library, out, links, held = p.tokenizer.library, {}, collections.Counter(), {}
    byte = {c: b for b, c in p.tokenizer.alphabet.items()}
    for r, t in texts:
        want = (" " + (t or "")).encode()
        a = library.encode(" " + (t or ""), add_special_tokens=False).ids
        b = p.pieces.encode(t or "")
        of_a = [bytes(byte[c] for c in library.id_to_token(i)) for i in a]
        of_b = [bytes([int(s[3:5], 16)]) if p.pieces.is_byte(i) else s.replace("▁", " ").encode() for i in b for s in [p.pieces.id_to_piece(i)]]
        if not t or b"".join(of_a) != want or b"".join(of_b) != want:
            held[r] = None
            continue
        span = lambda parts: [(sum(map(len, parts[:i])), sum(map(len, parts[: i + 1]))) for i in range(len(parts))] if len(parts) < 300 else list(zip(np.cumsum([0, *map(len, parts)])[:-1].tolist(), np.cumsum([*map(len, parts)]).tolist()))
        sa, sb = span(of_a), span(of_b)
        both = {e for _, e in sa} & {e for _, e in sb}
        pairs, j = [], 0
        for i, (s, e) in enumerate(sa):
            while sb[j][1] <= s:
                j += 1
            k = j
            while k < len(sb) and sb[k][0] < e:
                pairs.append((a[i], b[k]))
                k += 1
        groups, x, y = [], 0, 0
        for e in sorted(both):
            ga, gb = [], []
            while x < len(a) and sa[x][1] <= e:
                ga.append(a[x])
                x += 1
            while y < len(b) and sb[y][1] <= e:
                gb.append(b[y])
                y += 1
            groups.append(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}")
        held[r] = (len(a), len(b), groups, pairs)
        links.update(pairs)
    most = collections.Counter()
    for (_, b), n in links.items():
        most[b] = max(most[b], n)
    for r, h in held.items():
        out[r] = (0, 0, 0, 0, 0, 0, "") if h is None else (h[0], h[1], len(h[2]), len(h[3]), sum(links[x] == most[x[1]] for x in h[3]), sum(links[x] for x in h[3]), hashlib.sha256(";".join(h[2]).encode()).hexdigest())
    return out


FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute_alignment([(r.doc_id, r.text) for r in d.collect()])
    got = {r.doc_id: tuple(r[f] for f in FIELDS) for r in alignment.report(d).collect()}
    assert got == want and sum(w[3] for w in want.values()) > 1000


def test_alignment_odd(spark, monkeypatch):
    """Nulls, special tokens' strings, U+2581, equal and null ids, a long text, many small batches, no broadcast."""
    rng = random.Random(3)
    texts = [None, "", " ", "a", "a  b\n\n c", "▁x", "<|endoftext|> hi <s> <0x41>", "é 中文 😀ﬁ ①", "don't  stop\t\r\n", "\x00 null", "same text twice", "same text twice", "ﬁnal　wide", " ".join(f"w{rng.randrange(900)}é" for _ in range(30_000)), "😀" * 40]
    rows = [(None if i in (3, 4) else min(i, 12), t, "en", "a", 1) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, SCHEMA)
    want = sorted(brute_alignment(list(enumerate(texts))).values())
    assert sorted(tuple(r[f] for f in FIELDS) for r in alignment.report(clashing(d, "groups", "pairs", "times", "n_a")).collect()) == want
    monkeypatch.setattr(alignment, "BATCH_BYTES", 8)
    monkeypatch.setattr(alignment, "small", lambda counts: counts.select("*"))
    assert sorted(tuple(r[f] for f in FIELDS) for r in alignment.report(d).collect()) == want
    monkeypatch.setattr("lodeseek.llm.common.HOT_ROWS", 3)
    monkeypatch.setattr(alignment, "small", lambda counts: counts)
    assert sorted(tuple(r[f] for f in FIELDS) for r in alignment.report(d).collect()) == want
    assert alignment.report(d.limit(0)).count() == 0 and alignment.report(d.where("text is null")).first().groups_sha256 == ""


def test_groups_spell_the_text(spark):
    """The operator's own result: the ids of each group of both sides stand for the same bytes."""
    p = alignment.pair(alignment.tokenizer_file(), alignment.pieces_file())
    text = "Ünïcode text, don't  stop: 12345 \n done"
    r = alignment.aligned(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    spelled = []
    for g in r.groups.split(";"):
        a, b = ([v.spelled[int(i)] for i in side.split(",")] for v, side in zip((p.a, p.b), g.split("|")))
        assert b"".join(a) == b"".join(b)
        spelled += a
    assert b"".join(spelled) == (" " + text).encode() and sum(r.times) == r.n_links and len(r.groups.split(";")) == r.n_groups


# --- 13 hard negatives ---


def brute_negatives(rows, positives=5, negatives_=10):
    """Of (id, vector, label), by definition."""
    held = {}
    for i, v, l in rows:
        if i is not None and v is not None and l is not None and all(x is not None and math.isfinite(x) for x in v):
            held[i] = ([math.floor(256 * float(np.float32(x))) for x in v], (l + 1) % 10 if i % 7 == 0 else l)
    out = []
    for a, (q, label) in held.items():
        if a % 100:
            continue
        scores = {i: sum(x * y for x, y in zip(q, v)) for i, (v, _) in held.items()}
        first = lambda keep: sorted((i for i in held if keep(i)), key=lambda i: (-scores[i], i))
        for p in first(lambda i: i != a and held[i][1] == label)[:positives]:
            s = scores[p]
            for k, n in enumerate(first(lambda i: held[i][1] != label and 30 * s <= 100 * scores[i] <= 90 * s)[:negatives_]):
                out.append((a, p, k + 1, n, s, scores[n]))
    return sorted(out)


def mined(df):
    return sorted(tuple(r) for r in negatives.report(df).collect())


def test_hard_negatives(spark, sf):
    d = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = brute_negatives([tuple(r) for r in d.select("vec_id", "embedding", "label").collect()])
    assert mined(d) == want and len(want) > 50


@pytest.mark.parametrize("block,anchors,stretch", [(4096, 8192, 64), (37, 2, 1)])
def test_hard_negatives_odd(spark, block, anchors, stretch, monkeypatch):
    """Ties, copies, nulls, non-finite and shorter vectors, one label with most rows, several blocks and groups."""
    for name, x in (("BLOCK", block), ("ANCHORS", anchors), ("STRETCH", stretch)):
        monkeypatch.setattr(negatives, name, x)
    rng = np.random.default_rng(2)
    base = rng.normal(0, 0.1, (30, 6)).round(2)
    rows = [(i, (base[i % 30] + (rng.normal(0, 0.05, 6).round(2) if i % 3 else 0)).tolist(), int(i % 10) if i % 2 else 4) for i in range(700)]
    rows += [(None, [0.1] * 6, 1), (801, None, 1), (802, [0.1] * 6, None), (803, [0.1, None, 0.1, 0.1, 0.1, 0.1], 2), (804, [float("nan")] * 6, 2), (805, [float("inf")] + [0.0] * 5, 2), (900, [0.0] * 6, 3), (-100, [-0.3] * 6, 4)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = brute_negatives(rows)
    assert len(want) > 100 and mined(clashing(d, "v", "score", "place", "anchor", "g")) == want
    short = d.withColumn("embedding", F.when(F.col("vec_id") % 5 == 1, F.slice("embedding", 1, 4)).otherwise(F.col("embedding")))
    filled = [(r[0], r[1] + [0.0] * (6 - len(r[1])) if r[1] else r[1], r[2]) for r in map(tuple, short.collect())]
    assert mined(short) == brute_negatives(filled)
    assert mined(d.union(d.where("vec_id < 50"))) == want
    assert mined(d.limit(0)) == [] and mined(d.where("vec_id = 100")) == [] and mined(d.where("label is null")) == []


def test_approximations_bound_the_scores():
    """Bounds hold for every row, and keep most rows from being scored."""
    rng = np.random.default_rng(5)
    v = rng.normal(0, 40, (3000, 63)).astype(np.int64)
    q = rng.normal(0, 40, (70, 63)).astype(np.int64)
    low, high = negatives.Approximations(v).bounds(q, slice(100, 2900))
    exact = v[100:2900] @ q.T
    assert (low <= exact).all() and (exact <= high).all()
    a = negatives.Anchors(np.arange(70) * 10_000 + 5_000_000, np.zeros(70, np.int64), q, None, 5)
    a.meet(np.arange(3000), np.zeros(3000, np.int64), v)
    order = np.argsort(-(v @ q.T), axis=0, kind="stable")[:5]
    assert (a.best[0].ids.reshape(70, 5).T == order).all() and a.scored < 0.35 * a.met
