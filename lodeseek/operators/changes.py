"""What has changed between a scan and the index, and how to find out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare(scanned: DataFrame, indexed: DataFrame) -> DataFrame:
    """(path, status) from (path, content_hash) on both sides: added, modified, unchanged or deleted."""
    n = scanned.select("path", F.col("content_hash").alias("new"))
    o = indexed.select("path", F.col("content_hash").alias("old"))
    state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("new") == F.col("old"), "unchanged").otherwise("modified")
    return n.join(o, "path", "full_outer").select("path", state.alias("status"))


def compare_paths(paths: DataFrame, scanned: DataFrame, indexed: DataFrame) -> DataFrame:
    """The same for given paths only (those a version control names): in the scan they count as changed, else as deleted."""
    p = paths.select("path").distinct()
    mine = lambda df: df.join(p, "path", "left_semi")
    return compare(mine(scanned), mine(indexed))


@dataclass(frozen=True)
class ViewState:
    """What is known of a view when it was indexed, or of the working tree now."""

    head: str | None = None
    tree: str | None = None
    subtree: str | None = None
    dirty: bool = False
    fingerprint: str | None = None


def strategy(previous: ViewState | None, now: ViewState) -> str:
    """`full`, `skip` or `diff`.

    Without a previous state, or without version control, the scan is compared in full. The same tree, clean before
    and now, is skipped; so is the same fingerprint of a dirty tree. Else the named changes are compared.
    """
    if previous is None or now.tree is None or previous.tree is None:
        return "skip" if previous and previous.fingerprint and previous.fingerprint == now.fingerprint else "full"
    same = (previous.subtree or previous.tree) == (now.subtree or now.tree)
    if same and not now.dirty and not previous.dirty:
        return "skip"
    if now.fingerprint and previous.fingerprint == now.fingerprint:
        return "skip"
    return "full" if previous.dirty else "diff"
