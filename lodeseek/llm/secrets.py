"""Secret scans: fixed base patterns, and probabilistic automata inferred from labelled credentials.

Grammar inference: the labelled strings of a format make a prefix tree over the classes of their characters (digit,
lower, upper, else the character itself); each state also counts the characters themselves. States are merged (ALERGIA)
when a Hoeffding bound finds their endings, classes and characters, and those of their successors, compatible; so a
fixed prefix stays a chain of states and random parts become loops. The automaton gives a string's probability, with
characters of a class that a state hasn't seen smoothed and unseen classes at UNSEEN.

Candidates are all runs of 16 or more characters of `[A-Za-z0-9+/_.=-]` (less closing full stops), and all stretches of
16 or more characters of one to three neighbouring parts of a run between `=`, `/` and `.`; so a credential behind a
name, a path or in a longer run is scored on its own (one of four or more parts only as the whole run). All candidates are scored, those within base spans too. A score
is the log-likelihood a character less that of the best background (prose, capitals, numbers, names with signs). Each
format has a threshold: below it lie 2 % of held-out labelled strings, and no ordinary word made by rule reaches it (if
both can't be, the ordinary words count). A candidate is a secret of kind `format` if it reaches the threshold of a
format; of candidates that overlap, the one with the largest whole log-likelihood ratio stays, then the leftmost.

The default labelled strings are made by rule from published formats, so training is bounded and the same
everywhere; others can be given. The automata are inferred once, on the driver, and go to the tasks.

Null text is empty: no spans. Empty tables give empty ones; repeated rows are scanned alike; texts of any length are
scanned whole; other columns pass through whatever their names. Base spans stay as they are beside `format` spans.
"""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, ready, spare
from . import kernels

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
HINT = re.compile(r"(?ai:passw|secret|token|api_?key)")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
SHORTEST, PARTS, EDGES = 16, 3, re.compile("[=/.]")
#: Verdicts that a worker keeps, and the longest candidates among them: some 25 MB at most.
KEPT, KEPT_CHARS = 100_000, 200
#: Hoeffding's alpha of the compatibility test, probability of an unseen step, labelled strings a format, held out and ordinary ones.
ALPHA, UNSEEN, SAMPLES, HELD, ORDINARY = 0.05, 1e-5, 240, 200, 3_000

_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_ALNUM = _LOWER + _UPPER + _DIGIT
#: Published formats, as parts (characters, least length, most length); a part of one string is taken as it is.
FORMATS = {
    "access_key": [("AKIA",), (_UPPER + "234567", 16, 16)],
    "code_host": [("ghp_",), (_ALNUM, 36, 36)],
    "code_host_2": [("glpat-",), (_ALNUM + "_-", 20, 20)],
    "chat": [("xoxb-",), (_DIGIT, 11, 13), ("-",), (_DIGIT, 11, 13), ("-",), (_ALNUM, 24, 24)],
    "payment": [("sk_live_",), (_ALNUM, 24, 24)],
    "maps": [("AIza",), (_ALNUM + "_-", 35, 35)],
    "package": [("npm_",), (_ALNUM, 36, 36)],
    "web_token": [("eyJ",), (_ALNUM + "_-", 17, 60), (".eyJ",), (_ALNUM + "_-", 30, 90), (".",), (_ALNUM + "_-", 43, 43)],
    "digest": [("0123456789abcdef", 32, 64)],
    "digest_upper": [("0123456789ABCDEF", 32, 64)],
    "random_key": [(_ALNUM, 32, 40)],
    "access_secret": [(_ALNUM + "+/", 40, 40)],
}
#: Letters by frequency in English prose, in percent (fixed values).
LETTERS = dict(zip("etaoinshrdlcumwfgypbvkjxqz", (12.7, 9.1, 8.2, 7.5, 7.0, 6.7, 6.3, 6.1, 6.0, 4.3, 4.0, 2.8, 2.8, 2.4, 2.4, 2.2, 2.0, 2.0, 1.9, 1.5, 1.0, 0.8, 0.15, 0.15, 0.1, 0.07)))
SIGNS = "+/_.=-"


def labelled(samples: int = SAMPLES, seed: int = 7) -> dict[str, list[str]]:
    """Strings of each published format, made by rule."""
    rng = random.Random(seed)
    part = lambda p: p[0] if len(p) == 1 else "".join(rng.choice(p[0]) for _ in range(rng.randint(p[1], p[2])))
    return {name: ["".join(map(part, parts)) for _ in range(samples)] for name, parts in FORMATS.items()}


def ordinary(n: int = ORDINARY, seed: int = 9) -> list[str]:
    """Candidates that are no secrets, made by rule: long words, names, paths, numbers, dates, versions."""
    rng = random.Random(seed)
    letters = lambda k: "".join(rng.choices(list(LETTERS), list(LETTERS.values()), k=k))
    words = lambda lo, hi: [letters(rng.randint(2, 9)) for _ in range(rng.randint(lo, hi))]
    kinds = [
        lambda: letters(rng.randint(16, 36)), lambda: letters(rng.randint(16, 30)).capitalize(), lambda: letters(rng.randint(16, 30)).upper(), lambda: "".join(w.capitalize() for w in words(3, 6)), lambda: "_".join(words(3, 7)),
        lambda: "-".join(words(3, 7)), lambda: "/".join(words(3, 8)), lambda: ".".join(words(3, 6)), lambda: "".join(rng.choices(_DIGIT, k=rng.randint(16, 30))), lambda: f"{letters(6)}.{rng.randint(1, 99)}.{letters(7)}.{letters(3)}",
        lambda: f"/{'/'.join(words(2, 5))}/{rng.randint(1, 10**6)}.{letters(4)}", lambda: f"20{rng.randint(10, 30)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}/{'_'.join(words(2, 4))}", lambda: "_".join(words(3, 6)).upper() + f"={rng.randint(0, 10**9)}",
    ]
    return [x for x in (rng.choice(kinds)() for _ in range(n)) if len(x) >= SHORTEST]


def symbol(c: str) -> str:
    """The class of a character."""
    return "0" if c in _DIGIT else "a" if c in _LOWER else "A" if c in _UPPER else c


SIZES = {"0": 10, "a": 26, "A": 26}


class Automaton:
    """A probabilistic deterministic automaton inferred by merging states of a prefix tree.

    Of each state: next and count by class, raw counts by character, and how many strings end there. steps has, by
    state and character, the log-probability and the state after it.
    """

    def __init__(self, strings: list[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [defaultdict(int)]
        self.raw: list[dict[str, int]] = [defaultdict(int)]
        self.ends = [0]
        self.above: list[tuple[int, str]] = [(0, "")]  # of a state that is still in the tree
        for s in strings:
            at = 0
            for c in s:
                k = symbol(c)
                self.count[at][k] += 1
                self.raw[at][c] += 1
                if k not in self.next[at]:
                    self.next[at][k] = len(self.next)
                    self.next.append({})
                    self.count.append(defaultdict(int))
                    self.raw.append(defaultdict(int))
                    self.ends.append(0)
                    self.above.append((at, k))
                at = self.next[at][k]
            self.ends[at] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        red, blue = [0], sorted(self.next[0].values())
        while blue:
            b = blue.pop(0)
            for r in red:
                if self._compatible(r, b):
                    self._merge(r, b)
                    break
            else:
                red.append(b)
            inside = set(red)
            blue = sorted({t for r in red for t in self.next[r].values()} - inside)
        self._settle(red)

    def _total(self, q: int) -> int:
        return self.ends[q] + sum(self.count[q].values())

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return bool(n1 and n2) and abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        todo, seen = [(a, b)], set()
        while todo:
            pair = todo.pop()
            if pair in seen or pair[0] == pair[1]:
                continue
            seen.add(pair)
            a, b = pair
            n, m = self._total(a), self._total(b)
            if self._differ(self.ends[a], n, self.ends[b], m):
                return False
            for of in (self.count, self.raw):
                for c in of[a].keys() | of[b].keys():
                    if self._differ(of[a].get(c, 0), n, of[b].get(c, 0), m):
                        return False
            todo += [(self.next[a][c], self.next[b][c]) for c in self.next[a].keys() & self.next[b].keys()]
        return True

    def _merge(self, r: int, b: int) -> None:
        above, k = self.above[b]
        self.next[above][k] = r
        todo = [(r, b)]
        while todo:  # folds b's tree into r
            a, x = todo.pop()
            if a == x:
                continue
            self.ends[a] += self.ends[x]
            for of in (self.count, self.raw):
                for c, n in of[x].items():
                    of[a][c] += n
            for c, t in self.next[x].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], t))
                else:
                    self.next[a][c] = t
                    self.above[t] = (a, c)

    def _settle(self, red: list[int]) -> None:
        """Keeps the states that are left, and writes down all steps."""
        new = {q: i for i, q in enumerate(red)}
        self.next, self.count, self.raw, self.ends = [{c: new[t] for c, t in self.next[q].items()} for q in red], [dict(self.count[q]) for q in red], [dict(self.raw[q]) for q in red], [self.ends[q] for q in red]
        self.above, self.steps, self.stop = [], [], []
        for q in range(len(red)):
            n = self._total(q)
            self.stop.append(math.log(max(self.ends[q] / n, UNSEEN)))
            of_class = lambda k: max(self.count[q].get(k, 0) / n, UNSEEN)
            of_char = lambda c, k: (self.raw[q].get(c, 0) + 1 / SIZES.get(k, 1)) / (self.count[q].get(k, 0) + 1)
            self.steps.append({c: (math.log(of_class(k) * of_char(c, k)), self.next[q].get(k, q)) for c in _ALNUM + SIGNS for k in (symbol(c),)})

    def log_likelihood(self, s: str) -> float:
        """Of the string and its end."""
        at, total = 0, 0.0
        for c in s:
            p, at = self.steps[at][c]
            total += p
        return total + self.stop[at]


def backgrounds() -> list[dict[str, float]]:
    """Log-probabilities of characters in prose, capitals, numbers, and names with signs."""
    whole = sum(LETTERS.values())
    shares = ((0.93, 0.04, 0.01, 0.02), (0.03, 0.94, 0.01, 0.02), (0.01, 0.01, 0.9, 0.08), (0.76, 0.02, 0.04, 0.18))
    return [{c: math.log(lower * LETTERS[c] / whole if c in _LOWER else upper * LETTERS[c.lower()] / whole if c in _UPPER else digit / 10 if c in _DIGIT else sign / len(SIGNS)) for c in _ALNUM + SIGNS} for lower, upper, digit, sign in shares]


class Formats:
    """Automata of all formats, the backgrounds, and a threshold a format, calibrated on held-out and ordinary strings."""

    def __init__(self, strings: dict[str, list[str]], held_out: dict[str, list[str]], plain: list[str]):
        self.names = sorted(strings)
        self.automata = [Automaton(strings[name]) for name in self.names]
        self.backgrounds = backgrounds()
        no = [self.scores(x) for x in plain]
        self.thresholds = []
        for i, name in enumerate(self.names):
            good = sorted(self.scores(x)[i] for x in held_out[name])
            least = max((x[i] for x in no), default=-math.inf)
            self.thresholds.append(max(good[len(good) // 50] if good else -math.inf, least + 1e-9, 0.0))

    def scores(self, s: str) -> list[float]:
        """By format, the log-likelihood ratio a character against the best background."""
        plain = max(sum(map(b.__getitem__, s)) for b in self.backgrounds)
        return [(a.log_likelihood(s) - plain) / len(s) for a in self.automata]

    def verdict(self, s: str) -> tuple[str, float] | None:
        """Of the formats whose threshold the string reaches, the likeliest one and its score; None if there is none."""
        found = [(x, name) for x, t, name in zip(self.scores(s), self.thresholds, self.names) if x >= t]
        return max(found)[::-1] if found else None


@lru_cache(1)
def default_formats() -> Formats:
    return Formats(labelled(), labelled(HELD, 8), ordinary())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the base patterns."""
    spans = []
    if HINT.search(text):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return spans + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def candidates(text: str) -> Iterator[list[tuple[int, int]]]:
    """For each run its candidates [start, end)."""
    for run in CANDIDATE.finditer(text):
        a, b = run.start(), run.end()
        while text[b - 1] == "." and b > a:
            b -= 1
        cuts = [a - 1, *(m.start() for m in EDGES.finditer(text, a, b)), b]
        spans = {(a, b)} | {(cuts[i] + 1, cuts[j]) for i in range(len(cuts)) for j in range(i + 1, min(len(cuts), i + 1 + PARTS))}
        yield sorted((x, y) for x, y in spans if y - x >= SHORTEST)


def scan(text: str, formats: Formats, scored: dict) -> tuple[list[tuple], list[tuple]]:
    """Base spans, and all spans (start, kind's place, end, format, score), by start and kind. scored: verdicts so far."""
    base, extra = sorted((a, k, b, None, None) for a, k, b in base_spans(text)), []
    for spans in candidates(text):
        hits = []
        for a, b in spans:
            s = text[a:b]
            if (found := scored.get(s, scored)) is scored:
                found = formats.verdict(s)
                if len(s) <= KEPT_CHARS:  # longer ones are scored each time, so the verdicts kept have bounded bytes
                    if len(scored) >= KEPT:
                        scored.clear()
                    scored[s] = found
            if found:
                hits.append((-found[1] * (b - a), a, b, *found))
        kept: list[tuple] = []
        for _, a, b, name, x in sorted(hits):
            if all(b <= c or d <= a for c, _, d, _, _ in kept):
                kept.append((a, 3, b, name, round(x, 4)))
        extra += kept
    return base, sorted(base + extra)


SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("format", T.StringType()), T.StructField("score", T.DoubleType())])


def _scan(formats: Formats):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernels.begin("secrets")
        scored: dict = {}
        names = ("start", "kind", "end", "format", "score")
        span = pa.list_(pa.struct(list(zip(names, (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64())))))
        as_rows = lambda spans: [dict(zip(names, x)) for x in spans]
        for batch in batches:
            base, every = [], []
            for text in batch.column(1):
                x, y = scan(text.as_py() or "", formats, scored)
                base.append(as_rows(x))
                every.append(as_rows(y))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, span), pa.array(every, span)], ["row", "base", "spans"])

    return run


def scanned(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None, formats: Formats | None = None) -> DataFrame:
    """(row, base, spans): row is a struct of the carried columns (default: all but the text); spans have kind, format and score."""
    ready(docs.sparkSession)
    carry = [c for c in docs.columns if c != text_col] if carry is None else carry
    rows = docs.select(F.struct(*[col(c) for c in carry] or [F.lit(0).alias("none")]).alias("row"), col(text_col).alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("base", T.ArrayType(SPAN)), T.StructField("spans", T.ArrayType(SPAN))])
    return rows.mapInArrow(_scan(formats or default_formats()), schema)


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", formats: Formats | None = None) -> DataFrame:
    """docs with every span of the text replaced by mark; spans that overlap are replaced as one."""
    (whole,) = spare(docs, "whole_text")
    found = scanned(docs.withColumn(whole, col(text_col)), whole, docs.columns, formats)
    text = F.col("row").getField(text_col)
    # Walks the spans in order: what stood before each, then the mark, unless it lies in what is replaced already.
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, s: F.struct(
        F.when(s["end"] <= a["at"], a["out"]).when(s["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).alias("out"),
        F.greatest(a["at"], s["end"]).alias("at"),
    )
    done = F.aggregate("spans", start, step)
    cut = F.when(F.size("spans") > 0, F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))).otherwise(text)
    return found.select(*[(cut if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns])


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_assign, n_access, n_hex, base_sha256, spans, n_format, formats): formats names those of the `format` spans."""
    found = scanned(docs.select(col(id_col).alias("id"), col(text_col).alias("text")), "text", ["id"])
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    names = F.array(*map(F.lit, KINDS))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")
    return found.select(F.col("row.id").alias(id_col), of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_format"), F.array_join("spans.format", ",").alias("formats"))
