"""Version control by its command line; every call takes an argument list."""

from __future__ import annotations

import os
import re
import subprocess
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


def expand_home(path: str) -> str:
    return os.path.expanduser(path) if path == "~" or path.startswith("~/") else path


def repo_name(url: str) -> str:
    """The last part of a URL, HTTPS or SSH, without `.git`."""
    parts = [p for p in re.split(r"[/:]", re.sub(r"\.git$", "", url)) if p]
    return parts[-1] if parts else "repo"


def run(folder: str, *args: str) -> str:
    done = subprocess.run(["git", *args], cwd=folder, capture_output=True, text=True)
    if done.returncode:
        raise RuntimeError(done.stderr.strip() or f"git {args[0]} failed")
    return done.stdout


def clone_or_pull(url: str, branch: str, target: str) -> str:
    """A shallow clone, or a fast-forward pull where one is there."""
    if os.path.isdir(os.path.join(target, ".git")):
        run(target, "pull", "--ff-only")
    else:
        os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
        run(os.path.dirname(target) or ".", "clone", "--depth", "1", "--branch", branch, "--", url, target)
    return target


@dataclass(frozen=True)
class Snapshot:
    """A working tree: its root, the part of it, its reference and object ids."""

    root: str
    subpath: str | None = None
    kind: str = "workspace"
    ref: str | None = None
    head: str | None = None
    tree: str | None = None
    subtree: str | None = None
    dirty: bool = False


def context(path: str) -> tuple[str, str | None]:
    """The root of the repository around a path and the path below it; the path itself outside of one."""
    try:
        root = run(path, "rev-parse", "--show-toplevel").strip()
    except (RuntimeError, OSError):
        return path, None
    below = os.path.relpath(os.path.realpath(path), os.path.realpath(root))
    return root, None if below == "." else below.replace(os.sep, "/")


def current_ref(root: str) -> tuple[str, str]:
    """(`branch`, name), or (`detached`, `HEAD@short`)."""
    name = run(root, "rev-parse", "--abbrev-ref", "HEAD").strip()
    return ("branch", name) if name != "HEAD" else ("detached", "HEAD@" + run(root, "rev-parse", "--short", "HEAD").strip())


def branches(root: str) -> list[str]:
    return [b for b in run(root, "for-each-ref", "--format=%(refname:short)", "refs/heads").splitlines() if b]


def tree_of(root: str, subpath: str | None = None) -> str:
    return run(root, "rev-parse", f"HEAD:{subpath}" if subpath else "HEAD^{tree}").strip()


def _below(paths: list[str], subpath: str | None) -> list[str]:
    """Paths below subpath, without it."""
    if not subpath:
        return paths
    head = subpath.rstrip("/") + "/"
    return [p[len(head) :] for p in paths if p.startswith(head)]


def _listed(root: str, *args: str) -> list[str]:
    return [p for p in run(root, *args).split("\0") if p]


def diff_paths(root: str, old: str, new: str = "HEAD", subpath: str | None = None) -> list[str]:
    """Paths that differ between two commits; both names of a rename."""
    return _below(_listed(root, "diff", "--name-only", "--no-renames", "-z", old, new), subpath)


def worktree_paths(root: str, subpath: str | None = None) -> list[str]:
    """Tracked paths that differ from HEAD, staged or not."""
    return _below(_listed(root, "diff", "--name-only", "--no-renames", "-z", "HEAD"), subpath)


def untracked_paths(root: str, subpath: str | None = None) -> list[str]:
    return _below(_listed(root, "ls-files", "--others", "--exclude-standard", "-z"), subpath)


def is_ancestor(root: str, old: str, new: str = "HEAD") -> bool:
    """old is an ancestor of new; any failure is no."""
    try:
        return subprocess.run(["git", "merge-base", "--is-ancestor", old, new], cwd=root, capture_output=True).returncode == 0
    except OSError:
        return False


def snapshot(path: str) -> Snapshot:
    """The state of the tree around a path; outside of version control a bare workspace."""
    root, subpath = context(path)
    try:
        kind, ref = current_ref(root)
        head = run(root, "rev-parse", "HEAD").strip()
        dirty = bool(worktree_paths(root, subpath) or untracked_paths(root, subpath))
        return Snapshot(root, subpath, kind, ref, head, tree_of(root), tree_of(root, subpath), dirty)
    except (RuntimeError, OSError):
        return Snapshot(root, subpath)


def changed_paths(spark: SparkSession, s: Snapshot, since: str) -> DataFrame:
    """(path) of what has changed since a commit: committed, in the working tree, untracked."""
    paths = {*diff_paths(s.root, since, "HEAD", s.subpath), *worktree_paths(s.root, s.subpath), *untracked_paths(s.root, s.subpath)}
    return spark.createDataFrame([(p,) for p in sorted(paths)], "path string")
