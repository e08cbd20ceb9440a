"""Which files are indexed: ignore rules as one regular expression, extensions, size."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_BYTES = 1 << 20
#: Rules that always hold, and extensions of files that aren't text.
BUILTIN = ("node_modules", ".git", "dist", "build", ".next", "coverage", "*.lock", "package-lock.json")
BINARY = (".png", ".jpg", ".jpeg", ".gif", ".ico", ".svg", ".woff", ".woff2", ".ttf", ".eot", ".zip", ".tar", ".gz", ".rar", ".exe", ".dll", ".so", ".dylib", ".mp3", ".mp4", ".avi", ".mov")


def glob_regex(pattern: str) -> str:
    """A glob with `*`, `**`, `?` and classes as a regular expression over a relative path."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            inner = pattern[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
        elif c == "{" and (end := pattern.find("}", i)) > 0:
            out, i = out + "(?:" + "|".join(map(re.escape, pattern[i + 1 : end].split(","))) + ")", end + 1
        else:
            out, i = out + re.escape(c), i + 1
    return out


@dataclass(frozen=True)
class Rule:
    """A line of an ignore file: its regular expression, and whether it takes back an earlier one."""

    regex: str
    again: bool

    @staticmethod
    def parse(line: str) -> "Rule | None":
        line = line.rstrip("\n\r")
        if not line.strip() or line.startswith("#"):
            return None
        again = line.startswith("!")
        line = (line[1:] if again else line).strip()
        line = line[1:] if line.startswith("\\") else line
        folder = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        body = glob_regex(line.lstrip("/"))
        return Rule(("^" if anchored else "^(?:.*/)?") + body + ("/.*$" if folder else "(?:/.*)?$"), again)


@dataclass(frozen=True)
class Rules:
    """Rules in order: the last that matches a path decides."""

    rules: tuple[Rule, ...]

    @staticmethod
    def compiled(lines) -> "Rules":
        return Rules(tuple(r for r in map(Rule.parse, lines) if r))

    def ignores(self, path: str) -> bool:
        hit = False
        for r in self.rules:
            if re.search(r.regex, path):
                hit = not r.again
        return hit

    def kept(self, path: Column) -> Column:
        """The same as a column: one expression, no Python."""
        hit = F.lit(False)
        for r in self.rules:
            hit = F.when(path.rlike(r.regex), F.lit(not r.again)).otherwise(hit)
        return ~hit


def keeps(path: Column, gitignore: list[str] = (), ownignore: list[str] = (), exclude: list[str] = ()) -> Column:
    """Built-in rules, extensions, .gitignore, the engine's own ignore file, configured exclusions, in that order."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    out = Rules.compiled(BUILTIN).kept(path) & ~ext.isin(*BINARY)
    for lines in (gitignore, ownignore, exclude):
        if lines:
            out = out & Rules.compiled(lines).kept(path)
    return out


def visible(path: Column) -> Column:
    """No part of the path begins with a dot."""
    return ~path.rlike(r"(^|/)\.")


def included(path: Column, patterns: list[str]) -> Column:
    """The path matches one of the globs."""
    return path.rlike("|".join(f"(?:^{glob_regex(p)}$)" for p in patterns)) if patterns else F.lit(True)
