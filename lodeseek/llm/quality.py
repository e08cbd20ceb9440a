"""Quality rules: base counts and distribution divergence, with built-in functions only and row by row.

Each text gives two histograms: of character classes, and of common function words against all other words. A
language's reference is the median of each share over the whole corpus (documents long enough only), so junk up to
half of a language does not move it. Medians are exact over shares rounded to 1 / GRID, so they don't depend on how
rows are dealt. Digits are a class of their own.
A document is rejected when the Jensen-Shannon distance (base 2) from its language's reference exceeds the
threshold for either histogram. For words, the threshold is a part of the distance at which a text without any
function word stands from the reference; short texts, whose words scatter more, have a larger part. A histogram of
fewer characters or words than the guard says nothing. A language with fewer than MIN_DOCS long documents is held
against the character classes of all documents, and its words say nothing, as they do where the reference has hardly
any of the function words below. Base rules: fewer than 10 words, or more than a fifth of the words in 5-word windows
that occur twice.

Nothing is shuffled but the counts of the shares that occur (at most GRID a language and bin, combined in each task).
Windows are compared by 64-bit hashes inside the row; a text without a repeated window is settled by one distinct
count, others by one sort.

Null texts are empty (0 words: base_failed). A null language is a language. Empty tables give empty ones; repeated
rows are judged alike (and count each in the medians; of two middle shares the lower one counts); texts of any length
are read whole; other columns pass through whatever their names.
"""

from __future__ import annotations

from math import log
from zlib import crc32

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, col, only, small, spare, written

#: The commonest function words of the four languages.
COMMON = (
    "the of and to in is that it for was on are as with by this from be or an",
    "de la le et les des en un une du que est pour dans qui sur par au ne pas",
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch",
    "el los las del se por con una para su al lo como más pero sus este ya o sí",
)
VOCABULARY = tuple(sorted({w for line in COMMON for w in line.split()}))
#: A character for each common word, and a table of them by the word's checksum modulo SLOTS, where no two words meet.
CODES = tuple(chr(33 + i) for i in range(len(VOCABULARY)))
SLOTS = next(m for m in range(len(VOCABULARY), 1 << 20) if len({crc32(w.encode()) % m for w in VOCABULARY}) == len(VOCABULARY))
_CODE_AT = {crc32(w.encode()) % SLOTS: c for w, c in zip(VOCABULARY, CODES)}
#: At least so many characters and letter words before a histogram counts, and documents before a reference does.
MIN_CHARS, MIN_WORDS, MIN_DOCS = 200, 40, 20
#: Shares are rounded to multiples of 1 / GRID for the medians.
GRID = 10_000
#: Largest Jensen-Shannon distance of characters; that of words, as a part of the distance of a text without function
#: words, for texts of LONG letter words or more and for shorter ones; least such distance at which words say anything.
MAX_CHARS, LONG, PART_LONG, PART_SHORT, LEAST_BARE = 0.20, 200, 0.8, 0.9, 0.2
SYMBOLS = "[#*$%&|<>]"


def _without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def counted(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """docs with the base counts, and the names of those columns."""
    name = dict(zip(keys := ("text", "split", "words", "hashes", "windows", "sorted", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), spare(docs, *("q_" + k for k in keys))))
    c = {k: F.col(v) for k, v in name.items()}
    d = docs.withColumn(name["text"], F.coalesce(col(text_col), F.lit("")))
    d = d.withColumn(name["split"], F.split(c["text"], SPACES))
    outer = (c["split"][0] == "") | (F.element_at(c["split"], -1) == "")  # only the first and the last can be empty
    d = d.withColumn(name["words"], F.when(outer, F.filter(c["split"], lambda w: w != "")).otherwise(c["split"]))
    d = d.withColumn(name["hashes"], F.transform(c["words"], lambda w: F.xxhash64(w)))
    windows = F.transform(F.sequence(F.lit(0), F.size(c["hashes"]) - 5), lambda i: F.xxhash64(*[F.get(c["hashes"], i + k) for k in range(5)]))
    d = d.withColumn(name["windows"], F.when(F.size(c["hashes"]) >= 5, windows))
    placed = F.sort_array(F.transform(c["windows"], lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    d = d.withColumn(name["sorted"], F.when(F.size(F.array_distinct(c["windows"])) < F.size(c["windows"]), placed))
    again = F.filter(c["sorted"], lambda x, k: F.coalesce(F.get(c["sorted"], k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(c["sorted"], k + 1)["h"] == x["h"], F.lit(False)))
    starts = F.sort_array(F.transform(again, lambda x: x["i"]))
    covered = F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last")), lambda a, x: F.struct((a["n"] + F.least(F.lit(5), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])
    lines = F.filter(F.split(c["text"], "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumns({
        name["n_words"]: F.size(c["words"]).cast("long"),
        name["word_chars"]: F.length(F.array_join(c["words"], "")).cast("long"),
        name["n_symbols"]: _without(c["text"], "[^#*$%&|<>]+").cast("long"),
        name["n_dup_lines"]: F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long"),
        name["n_repeat_words"]: F.coalesce(covered, F.lit(0)).cast("long"),
    })
    return d.drop(*[name[k] for k in ("text", "split", "words", "hashes", "windows", "sorted")]), name


def histograms(docs: DataFrame, text_col: str = "text", number_col: str | None = None) -> tuple[DataFrame, str, str]:
    """docs with two arrays of shares: of character classes and of common words; null where the guard says so.

    With number_col, also the number of letter words, under that name.
    """
    t, rare, low, number, kept, classes, words = spare(docs, "h_text", "h_rare", "h_low", "h_number", "h_common", "h_classes", "h_words")
    text = F.col(t)
    d = docs.withColumn(t, F.coalesce(col(text_col), F.lit("")))
    n = F.length(text)
    d = d.withColumn(rare, F.regexp_replace(text, "[a-z]+", ""))  # other classes are counted on what is left
    some = [F.length(rare) - _without(F.col(rare), p) for p in ("[A-Z]+", "[0-9]+", r"[\x20\x09-\x0D]+", r"[^\x00-\x7F]+", r"[.,;:!?'\"()-]+", SYMBOLS)]
    d = d.withColumn(classes, F.when(n >= MIN_CHARS, F.array(n, *some)))
    shares = lambda c, total: F.transform(c, lambda x: x / total)
    rest = F.col(classes)[0] - sum((F.col(classes)[k] for k in range(1, 7)), F.lit(0))
    d = d.withColumn(low, F.split(F.lower(text), r"\P{L}+"))
    outer = (F.col(low)[0] == "").cast("int") + ((F.size(low) > 1) & (F.element_at(low, -1) == "")).cast("int")  # only the first and the last can be empty
    d = d.withColumn(number, F.size(low) - outer)
    codes = F.split(F.lit(" ".join(_CODE_AT.get(i, "~") for i in range(SLOTS))), " ")
    common = F.transform(F.filter(low, lambda w: w.isin(*VOCABULARY)), lambda w: F.get(codes, (F.crc32(w) % SLOTS).cast("int")))
    d = d.withColumn(kept, F.when(F.col(number) >= MIN_WORDS, F.array_join(common, "")))
    times = F.transform(F.split(F.lit(" ".join(CODES)), " "), lambda c: F.octet_length(F.col(kept)) - F.octet_length(F.replace(F.col(kept), c, F.lit(""))))
    d = d.withColumn(words, F.when(F.col(kept).isNotNull(), F.concat(F.array(F.col(number)), times)))
    other = F.col(words)[0] - F.aggregate(F.slice(words, 2, len(VOCABULARY)), F.lit(0), lambda a, x: a + x)
    d = d.withColumns({
        classes: shares(F.concat(F.array(rest), F.slice(classes, 2, 6)), F.col(classes)[0]),
        words: shares(F.concat(F.array(other), F.slice(words, 2, len(VOCABULARY))), F.col(words)[0]),
    })
    if number_col is not None:
        d = d.withColumn(number_col, F.col(number))
    return d.drop(t, rare, low, number, kept), classes, words


def _medians(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., n0, n1, classes, words): documents and median shares of both histograms, from (lang, kind, i, v, n).

    Rows of i = -1 count the documents; shares of 0 aren't listed.
    """
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in (*keys, "kind")]
    counts = counts.groupBy(*keys, "kind", "i", "v").agg(F.sum("n").alias("n"))
    docs = counts.where("i < 0").select(*keys, "kind", F.col("n").alias("docs"))
    of_bin = Window.partitionBy(*keys, "kind", "i")
    rows = counts.where("i >= 0").withColumns({"upto": F.sum("n").over(of_bin.orderBy("v")), "some": F.sum("n").over(of_bin)})
    both = same("r", "d")
    rows = rows.alias("r").join(docs.alias("d"), both[0] if len(both) == 1 else both[0] & both[1]).select("r.*", "docs")
    # Half of the documents or more are at 0, or at a share that is listed.
    at = rows.where("2 * (docs - some) < docs and 2 * (docs - some + upto) >= docs").groupBy(*keys, "kind", "i").agg(F.min("v").alias("v"))
    every = docs.select(*keys, "kind", F.lit(-1).alias("i"), F.col("docs").alias("v")).unionByName(at)
    of = lambda k, size: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.element_at(F.map_from_entries(F.collect_list(F.when((F.col("kind") == k) & (F.col("i") >= 0), F.struct("i", (F.col("v") / GRID).alias("v"))))), i), F.lit(0.0)))
    n = lambda k: F.coalesce(F.max(F.when((F.col("kind") == k) & (F.col("i") < 0), F.col("v"))), F.lit(0))
    out = every.groupBy(*keys).agg(n(0).alias("n0"), n(1).alias("n1"), of(0, 7).alias("classes"), of(1, len(VOCABULARY) + 1).alias("words"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    filled = lambda c: F.when(total(c) > 0, F.transform(c, lambda x: x / total(c))).alias(c)
    return out.select(*keys, "n0", "n1", filled("classes"), filled("words"))


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, classes, words): each language's median histograms over all documents.

    Below MIN_DOCS documents the classes are those of all documents, and words are null.
    """
    d, classes, words = histograms(docs.select(col(lang_col).alias("lang"), col(text_col).alias("text")), "text")

    def bins(kind: int, c: str) -> Column:
        held = F.filter(F.transform(F.col(c), lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.floor(x * GRID + 0.5).cast("int").alias("v"))), lambda x: x["v"] > 0)
        one = F.array(F.struct(F.lit(kind).alias("kind"), F.lit(-1).alias("i"), F.lit(0).alias("v")))
        return F.when(F.col(c).isNotNull(), F.concat(one, held)).otherwise(F.slice(one, 1, 0))

    counts = d.select("lang", F.explode(F.concat(bins(0, classes), bins(1, words))).alias("x")).groupBy("lang", "x.kind", "x.i", "x.v").agg(F.count("*").alias("n"))
    counts = written(counts, "shares")
    whole = _medians(counts.where("kind = 0"), []).select("classes").first()
    every = F.array(*map(F.lit, whole["classes"])) if whole and whole["classes"] else F.lit(None).cast("array<double>")
    return _medians(counts, ["lang"]).select("lang", F.when(F.col("n0") >= MIN_DOCS, F.col("classes")).otherwise(every).alias("classes"), F.when(F.col("n1") >= MIN_DOCS, F.col("words")).alias("words"))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of shares; null if one is null."""
    part = lambda a, b: F.when(a > 0, a * F.ln(2 * a / (a + b))).otherwise(0.0)
    total = F.aggregate(F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a)), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.when(total < 0, 0.0).otherwise(total) / (2 * log(2)))


def judged(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", refs: DataFrame | None = None) -> tuple[DataFrame, dict[str, str]]:
    """docs with the base counts, base_failed, both distances and kept, and the names of these columns."""
    refs = written(references(docs, text_col, lang_col) if refs is None else refs, "references")
    d, name = counted(docs, text_col)
    (number,) = spare(d, "n_letter_words")
    d, classes, words = histograms(d, text_col, number)
    lang, rc, rw, bare, most, failed, dc, dw, kept = spare(d, "r_lang", "r_classes", "r_words", "r_bare", "r_most", "base_failed", "char_distance", "word_distance", "kept")
    none = F.array(*[F.lit(float(k == 0)) for k in range(len(VOCABULARY) + 1)])
    refs = refs.toDF(lang, rc, rw).withColumn(bare, distance(none, F.col(rw)))
    d = d.join(small(refs), col(lang_col).eqNullSafe(F.col(lang)), "left")
    part = F.when(F.col(number) >= LONG, F.lit(PART_LONG)).otherwise(F.lit(PART_SHORT))
    d = d.withColumns({dc: distance(F.col(classes), F.col(rc)), dw: distance(F.col(words), F.col(rw)), most: F.when(F.col(bare) >= LEAST_BARE, part * F.col(bare))}).drop(classes, words, lang, rc, rw, bare, number)
    d = d.withColumn(failed, (F.col(name["n_words"]) < 10) | (100 * F.col(name["n_repeat_words"]) > 20 * F.col(name["n_words"])))
    ok = ~F.col(failed) & (F.coalesce(F.col(dc), F.lit(0.0)) <= MAX_CHARS) & F.coalesce(F.col(dw) <= F.col(most), F.lit(True))
    counts = {k: name[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    return d.withColumn(kept, ok).drop(most), counts | {"base_failed": failed, "char_distance": dc, "word_distance": dw, "kept": kept}


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, both distances)."""
    own = docs.select(col(id_col).alias("id"), col(text_col).alias("text"), col(lang_col).alias("lang"))
    d, name = judged(own)
    keys = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")
    return d.select(F.col("id").alias(id_col), *[F.col(name[k]).alias(k) for k in keys])


def passed(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that are kept; their columns as they were."""
    d, name = judged(docs, text_col, lang_col)
    return only(d, name["kept"], docs.columns)
