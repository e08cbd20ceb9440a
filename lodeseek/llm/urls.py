"""URL filters: rules, and a character language-model ratio for what no rule decides; built-in functions only.

URLs that a rule decides train two variable-order Markov models, accepted and rejected. A model's contexts are two
symbols, one or none: a longer context stands only where it has been seen EVIDENCE times and explains the symbols that
followed it better than the shorter one by GAIN nats, else it is pruned and the shorter one speaks. What stands is
smoothed by Witten-Bell (a context gives way to the next shorter one by how many different symbols have followed it).
A URL's score is the difference of the two log-likelihoods a symbol.

A fifth of the ruled URLs, chosen by checksum, trains nothing: on it the threshold is calibrated, where the shares of
accepted URLs that would be blocked and of rejected ones that would pass are least in sum (in the middle, if many
thresholds are as good). That sum is the model's stated error. If the held-out part lacks a class, all ruled URLs
calibrate.

Letters are lower-cased, digits count as one symbol, other characters outside the alphabet as another; so the
table of log ratios has SIZE ** 3 numbers (64,000) at any size of the input. It is summed over all ruled URLs before
the shuffle, collected, and held in the plan as one array that each row looks up in place; no URL is shuffled.

Null URLs, or URLs without `://`, have an empty host and path and fit no rule; a null or empty URL scores nothing and
is allowed, as is every URL while one class has no example. Of rules of equal length the later in code-point order
wins. URLs of any length are scored whole. Repeated rows are judged alike (and each counts in training), empty tables
give empty ones, other columns pass through whatever their names.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, only, spare

#: (verdict, host and path) of the contract's rules.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
ALPHABET = "abcdefghijklmnopqrstuvwxyz0/.-?&=_%:#~+"
#: How often a context must be seen, and by how many nats it must explain more than the shorter one; bins of scores a unit.
EVIDENCE, GAIN, BINS = 8, 4.0, 1_000
#: Symbol 0 stands for the start and for characters outside the alphabet.
SIZE = len(ALPHABET) + 1


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path: empty for null and without `://`."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://(.*)\z", 1)
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def ruled(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none does."""
    which, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, p = rule.split("/", 1)
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        which, verdict = F.when(fits, rule).otherwise(which), F.when(fits, v).otherwise(verdict)
    return which, verdict


def triples(url: Column) -> Column:
    """Each symbol with the two before it, as one number below SIZE ** 3."""
    low = F.regexp_replace(ascii_lower(url), "[0-9]", "0")
    codes = F.transform(F.filter(F.split(low, ""), lambda c: c != ""), lambda c: F.position(c, F.lit(ALPHABET)))
    padded = F.concat(F.array(F.lit(0), F.lit(0)), codes)
    pairs = F.zip_with(padded, F.slice(padded, 2, 1 << 30), lambda a, b: a * SIZE + b)
    return F.filter(F.zip_with(pairs, F.slice(padded, 3, 1 << 30), lambda a, b: a * SIZE + b), lambda x: x.isNotNull())


def ratios(examples: DataFrame) -> DataFrame:
    """(triple, ratio) for all triples, from rows (url, verdict): log P(allow) - log P(block)."""
    every = examples.sparkSession.range(SIZE**3).select(F.col("id").cast("int").alias("triple"))
    n = examples.select("verdict", F.explode(triples(F.col("url"))).alias("triple")).groupBy("triple").agg(*[F.sum((F.col("verdict") == v).cast("double")).alias(v) for v in ("allow", "block")])
    t = every.join(n, "triple", "left").na.fill(0.0).withColumns({"pair": (F.col("triple") / SIZE).cast("int"), "mid": (F.col("triple") / SIZE).cast("int") % SIZE, "one": F.col("triple") % SIZE})
    for v in ("allow", "block"):
        none, mid, pair = Window.partitionBy(F.lit(0)), Window.partitionBy("mid"), Window.partitionBy("pair")
        once = F.col("triple") < SIZE * SIZE  # of the triples with one ending of two symbols
        t = t.withColumns({"c0": F.sum(v).over(Window.partitionBy("one")), "c1": F.sum(v).over(Window.partitionBy("mid", "one")), "all0": F.sum(v).over(none), "all1": F.sum(v).over(mid), "all2": F.sum(v).over(pair)})
        t = t.withColumns({"kinds1": F.sum(((F.col("c1") > 0) & once).cast("double")).over(mid), "kinds2": F.sum((F.col(v) > 0).cast("double")).over(pair), "p0": (F.col("c0") + 1) / (F.col("all0") + SIZE)})
        t = t.withColumn("w1", (F.col("c1") + (F.col("kinds1") + 1) * F.col("p0")) / (F.col("all1") + F.col("kinds1") + 1))
        t = t.withColumn("gain1", F.sum(F.when(once, F.col("c1") * F.ln(F.col("w1") / F.col("p0"))).otherwise(0.0)).over(mid))
        t = t.withColumn("p1", F.when((F.col("all1") >= EVIDENCE) & (F.col("gain1") >= GAIN), F.col("w1")).otherwise(F.col("p0")))
        t = t.withColumn("w2", (F.col(v) + (F.col("kinds2") + 1) * F.col("p1")) / (F.col("all2") + F.col("kinds2") + 1))
        t = t.withColumn("gain2", F.sum(F.col(v) * F.ln(F.col("w2") / F.col("p1"))).over(pair))
        t = t.withColumn(f"log_{v}", F.ln(F.when((F.col("all2") >= EVIDENCE) & (F.col("gain2") >= GAIN), F.col("w2")).otherwise(F.col("p1"))))
    return t.select("triple", (F.col("log_allow") - F.col("log_block")).alias("ratio"))


def threshold(scored: list[tuple[int, int, int]]) -> tuple[float, float] | None:
    """The least score to allow, and the sum of both error shares, from (bin, accepted, rejected) in ascending order of bins."""
    allow, block = sum(r[1] for r in scored), sum(r[2] for r in scored)
    if not allow or not block:
        return None
    missed, passed, found = 0, block, []
    for at, a, b in [*scored, (scored[-1][0] + 1, 0, 0)]:  # blocks what lies below bin `at`
        found.append((missed / allow + passed / block, at))
        missed, passed = missed + a, passed - b
    least = min(x for x, _ in found)
    best = [i for i, (x, _) in enumerate(found) if x == least]
    i = best[len(best) // 2]
    below = found[i - 1][1] + 1 if i else found[i][1]  # bins between this one and the one before are empty
    return (below + found[i][1]) / 2 / BINS, least


@dataclass
class Model:
    """score of a URL column, the score below which to block, and the sum of both error shares on held-out URLs."""

    score: Callable[[Column], Column]
    threshold: float
    error: float


def fitted(pages: DataFrame, url_col: str = "url", rules: tuple = RULES) -> Model | None:
    """The model of all ruled URLs of pages; None if a class has no example."""
    host, path = parts(col(url_col))
    examples = pages.select(col(url_col).alias("url"), ruled(host, path, rules)[1].alias("verdict")).where("verdict is not null")
    held = F.crc32(F.encode("url", "UTF-8")) % 5 == 0
    rows = ratios(examples.where(~held)).orderBy("triple").collect()  # SIZE ** 3 rows, always
    table = F.from_json(F.lit(json.dumps([round(r.ratio, 6) for r in rows])), "array<double>")

    def score(url: Column) -> Column:
        t = triples(url)
        return F.aggregate(F.transform(t, lambda x: F.get(table, x)), F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda a, x: F.struct((a["s"] + x).alias("s"), (a["n"] + 1).alias("n")), lambda a: F.try_divide(a["s"], a["n"]))

    of = lambda v: F.count_if(F.col("verdict") == v)
    bins = examples.select("verdict", held.alias("held"), F.floor(score(F.col("url")) * BINS).cast("long").alias("bin")).where("bin is not null").groupBy("held", "bin").agg(of("allow").alias("allow"), of("block").alias("block")).collect()
    every = Counter()  # a row a bin of scores, which lie between -12 and 12
    for r in bins:
        every[r.bin, 1] += r.allow
        every[r.bin, 2] += r.block
    at = threshold(sorted((r.bin, r.allow, r.block) for r in bins if r.held)) or threshold([(b, every[b, 1], every[b, 2]) for b in sorted({b for b, _ in every})])
    return at and Model(score, *at)


def judged(pages: DataFrame, url_col: str = "url", rules: tuple = RULES) -> tuple[DataFrame, dict[str, str]]:
    """pages with host, path, rule, verdict and score, and the names of these columns."""
    names = spare(pages, "host", "path", "rule", "verdict", "score")
    host, path = parts(col(url_col))
    rule, verdict = ruled(host, path, rules)
    model = fitted(pages, url_col, rules)
    score = F.lit(None).cast("double") if model is None else model.score(col(url_col))
    guess = F.lit("allow") if model is None else F.when(score < model.threshold, "block").otherwise("allow")
    columns = dict(zip(names, (host, path, rule, F.coalesce(verdict, guess), score)))
    return pages.withColumns(columns), dict(zip(("host", "path", "rule", "verdict", "score"), names))


def allowed(pages: DataFrame, url_col: str = "url", rules: tuple = RULES) -> DataFrame:
    """The rows of pages whose URLs are allowed; their columns as they were."""
    d, name = judged(pages, url_col, rules)
    (ok,) = spare(d, "allowed")
    return only(d.withColumn(ok, F.col(name["verdict"]) == "allow"), ok, pages.columns)


def report(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id_col, host, path, rule, verdict, score)."""
    d, name = judged(pages.select(col(id_col).alias("id"), col(url_col).alias("url")))
    return d.select(F.col("id").alias(id_col), *[F.col(name[k]).alias(k) for k in ("host", "path", "rule", "verdict", "score")])
