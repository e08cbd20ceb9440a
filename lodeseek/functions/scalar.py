"""Scalar functions: fingerprints, gates, prompts, placeholders, fragments, escaping."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SNIPPET, GATE_LENGTH, HEAD = 500, 200, 256


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def byte_size(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def snippet(text: Column) -> Column:
    return F.substring(text, 1, SNIPPET)


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def normal_path(path: Column) -> Column:
    """Forward slashes, no leading `./` or `/`."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./|/)+", "")


def kind(metadata: Column, source_type: Column) -> Column:
    """The fragment type of a chunk's metadata, else its source type."""
    return F.coalesce(F.get_json_object(metadata, "$.fragmentType"), source_type)


def has_docstring(text: Column) -> Column:
    """A comment or string of documentation begins within the first characters."""
    head = F.substring(text, 1, HEAD)
    return F.contains(head, F.lit("/**")) | F.contains(head, F.lit("/*!")) | F.contains(head, F.lit('"""'))


def gate(text: Column, kind: Column) -> Column:
    """Why a chunk is not summarised; null if it is."""
    short = F.lower(kind)
    return F.when(F.length(text) < GATE_LENGTH, F.lit(f"content<{GATE_LENGTH}")).when(short.isin("type", "interface") & ~has_docstring(text), F.concat(short, F.lit("-without-docstring")))


def skipped(reason: Column) -> Column:
    return F.concat(F.lit("[skipped:"), reason, F.lit("]"))


def failed(reason: Column) -> Column:
    return F.concat(F.lit("[failed:"), reason, F.lit("]"))


def prompt(path: Column, kind: Column, text: Column, fqn: Column | None = None, language: Column | None = None) -> Column:
    """Path, kind, name and language if known, a rule, and the text; lines whose value is null are left out."""
    label = lambda name, c: F.concat(F.lit(name + ": "), c)
    lines = [label(name, c) for name, c in (("Path", path), ("Kind", kind), ("FQN", fqn), ("Language", language)) if c is not None]
    return F.concat_ws("\n", *lines, F.lit("---"), text)


def mock_wording(path: Column, kind: Column, text: Column, fqn: Column | None = None) -> Column:
    """What the stand-in says of a text, blank or not; null for null. The wording is a fixed value."""
    name = F.lit("") if fqn is None else F.coalesce(F.concat(F.lit(" ("), fqn, F.lit(")")), F.lit(""))
    digest = F.substring(F.sha2(F.concat(path, F.lit("|"), text), 256), 1, 8)
    return F.concat(F.lit("Mock summary "), digest, F.lit(": "), F.lower(kind), name, F.lit(" in "), path, F.lit(". Content length "), F.length(text).cast("string"), F.lit(" chars; generated deterministically for tests."))


def mock_summary(path: Column, kind: Column, text: Column, fqn: Column | None = None) -> Column:
    """A deterministic stand-in for a model's summary; null for blank text."""
    return F.when(F.trim(text) != "", mock_wording(path, kind, text, fqn))


def fingerprint(dirty: Column, tree: Column, manifest: Column) -> Column:
    """`tree:oid` for a clean tree, `dirty:oid:hash` for a changed one, `workspace:hash` without a tree."""
    return F.when(tree.isNull(), F.concat(F.lit("workspace:"), manifest)).when(dirty, F.concat(F.lit("dirty:"), tree, F.lit(":"), manifest)).otherwise(F.concat(F.lit("tree:"), tree))


def fragment(text: Column, start: Column, end: Column, context: Column) -> tuple[Column, Column, Column]:
    """Lines [start - context, end + context] clamped to the text; end defaults to start, both to the whole text."""
    lines = F.split(text, "\n")
    n = F.size(lines)
    first = F.greatest(F.lit(1), F.coalesce(start, F.lit(1)) - context)
    last = F.least(n, F.coalesce(end, start, n) + context)
    body = F.when(last < first, F.lit("")).otherwise(F.array_join(F.slice(lines, first, F.greatest(F.lit(0), last - first + 1)), "\n"))
    return first, last, body


def format_cost(cost: float) -> str:
    """Below a cent in thousandths, else with three decimals."""
    return f"${cost * 1000:.2f}m" if cost < 0.01 else f"${cost:.3f}"


def cost_text(cost: Column) -> Column:
    """format_cost for a column; null for null.

    format_number rounds the double's exact value, as printf of C does; format_string rounds its shortest decimal form.
    """
    rounded = lambda x, places: F.call_function("format_number", x, F.lit("0." + "0" * places))
    return F.when(cost < 0.01, F.concat(F.lit("$"), rounded(cost * 1000, 2), F.lit("m"))).otherwise(F.concat(F.lit("$"), rounded(cost, 3)))


def js_round(x: float) -> int:
    """Rounds halves up."""
    return math.floor(x + 0.5)


def escape_value(c: Column, dtype: str) -> Column:
    """A value as SQL text: NULL, booleans and numbers plainly, vectors and JSON as quoted literals, strings escaped."""
    quote = lambda x: F.concat(F.lit("E'"), F.replace(F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("'"))
    if dtype.startswith("array<"):
        text = F.concat(F.lit("'["), F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit("]'::vector"))
    elif dtype.startswith(("struct<", "map<")):
        text = F.concat(quote(F.to_json(c)), F.lit("::jsonb"))
    elif dtype == "boolean":
        text = F.when(c, F.lit("TRUE")).otherwise(F.lit("FALSE"))
    elif dtype == "timestamp":
        text = F.concat(F.lit("'"), F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit("'"))
    elif dtype == "string":
        text = quote(c)
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit("NULL"))


def insert_text(table: str, columns: dict[str, str], on_conflict: bool = False) -> Column:
    """An INSERT statement for a row with the given columns and types."""
    names = ", ".join(columns)
    values = F.concat_ws(", ", *[escape_value(F.col(c), t) for c, t in columns.items()])
    return F.concat(F.lit(f"INSERT INTO {table} ({names}) VALUES ("), values, F.lit(")" + " ON CONFLICT DO NOTHING" * on_conflict + ";"))
