"""Tokens of TypeScript/JavaScript, Java and Kotlin with their brackets matched, whatever the code is like.

Each language says what its strings and comments look like; what stands in them are never tokens of their own: templates with
code in `${ }` that has strings and braces itself, regular expressions, text blocks, nested comments. A quote that isn't
closed on its line is a sign like others, and brackets without a partner are passed over, so any text gives tokens.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

WORD, SIGN, TEXT, COMMENT = "word", "sign", "text", "comment"
_WORD = re.compile(r"[#@]?[^\W\d][\w$]*|[#@]?\$[\w$]*|\d[\w.]*")
_QUOTED = re.compile(r"`[^`\n]+`")
_SIGN = re.compile(r"=>|->|::|\?\.|\S", re.S)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
PAIRS = {"(": ")", "[": "]", "{": "}"}
#: Words after which a slash begins a regular expression.
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "instanceof", "yield", "await"}
DEEPEST = 60


@dataclass(frozen=True)
class Syntax:
    """quotes: those that end with their line or themselves; `long`: quotes over lines; templates: of these, those with code in ${ }."""

    quotes: str
    long: tuple[str, ...]
    templates: tuple[str, ...] = ()
    nested_comments: bool = False
    regex: bool = False
    quoted_names: bool = False


@dataclass
class Token:
    kind: str
    text: str
    line: int
    last: int
    fresh: bool  # the first on its line, comments aside


class Code:
    """tokens without comments; notes: for each the first lines of the comments right before it; close: partners of brackets."""

    def __init__(self, text: str, syntax: Syntax):
        self.text, self.syntax = text, syntax
        self.tokens: list[Token] = []
        self.notes: list[list[int]] = []
        line, held, fresh, before = 1, [], True, None
        for kind, start, end in self._read(0, None, 0):
            gap_line = line + text.count("\n", before or 0, start)
            fresh = fresh or gap_line > line or before is None
            last = gap_line + text.count("\n", start, end)
            if kind == COMMENT:
                held.append(gap_line)
                fresh = fresh or last > gap_line
            else:
                self.tokens.append(Token(kind, text[start:end], gap_line, last, fresh))
                self.notes.append(held)
                held, fresh = [], False
            line, before = last, end
        self.close: dict[int, int] = {}
        stack: list[int] = []
        for i, t in enumerate(self.tokens):
            if t.kind == SIGN and t.text in PAIRS:
                stack.append(i)
            elif t.kind == SIGN and t.text in ")]}":
                # Of the brackets still open, DEEPEST at most are passed over; a round or square one ends at its block's end.
                for k in range(len(stack) - 1, max(-1, len(stack) - 1 - DEEPEST), -1):
                    opened = self.tokens[stack[k]].text
                    if PAIRS[opened] == t.text:
                        self.close[stack[k]] = i
                        del stack[k:]
                        break
                    if opened == "{":
                        break

    def _read(self, at: int, until: str | None, depth: int):
        """(kind, start, end) of the tokens from `at`; with until, up to the bracket that closes what is open."""
        text, s, open_ = self.text, self.syntax, 0
        previous = None
        while at < len(text):
            c = text[at]
            if c.isspace():
                at += 1
                continue
            if text.startswith("//", at):
                end = text.find("\n", at)
                kind, end = COMMENT, len(text) if end < 0 else end
            elif text.startswith("/*", at):
                kind, end = COMMENT, self._comment(at)
            elif (end := self._text(at, depth)) > at:
                kind = TEXT
            elif s.regex and c == "/" and (previous is None or previous[0] == SIGN and previous[1] not in ")]}" or previous[1] in _BEFORE_REGEX) and (m := _REGEX.match(text, at)):
                kind, end = TEXT, m.end()
            elif m := _WORD.match(text, at) or s.quoted_names and _QUOTED.match(text, at):
                kind, end = WORD, m.end()
            else:
                kind, end = SIGN, _SIGN.match(text, at).end()
                if until:
                    open_ += text[at:end] == "{"
                    open_ -= text[at:end] == "}"
                    if open_ < 0:
                        yield SIGN, at, end
                        return
            yield kind, at, end
            if kind != COMMENT:
                previous = kind, text[at:end]
            at = end

    def _comment(self, at: int) -> int:
        if not self.syntax.nested_comments:
            end = self.text.find("*/", at + 2)
            return len(self.text) if end < 0 else end + 2
        depth = 0
        for m in re.compile(r"/\*|\*/").finditer(self.text, at):
            depth += 1 if m.group() == "/*" else -1
            if not depth:
                return m.end()
        return len(self.text)

    def _text(self, at: int, depth: int) -> int:
        """The end of the string that begins at `at`; `at` where none does."""
        text, s = self.text, self.syntax
        quote = next((q for q in s.long if text.startswith(q, at)), None)
        if quote is None:
            quote = text[at] if text[at] in s.quotes else None
        if quote is None:
            return at
        i, one_line, code = at + len(quote), quote not in s.long, quote in s.templates
        while i < len(text):
            if text.startswith(quote, i):
                i += len(quote)
                while len(quote) == 3 and i < len(text) and text[i] == quote[0]:
                    i += 1  # quotes at the end of a text block
                return i
            if text[i] == "\n" and one_line:
                return at
            if text[i] == "\\" and not (len(quote) == 3 and s.nested_comments):
                i += 2
            elif code and text.startswith("${", i) and depth < DEEPEST:
                end = i + 2
                for _, _, end in self._read(i + 2, "}", depth + 1):
                    pass
                i = max(end, i + 2)
            else:
                i += 1
        return at if one_line else len(text)

    # --- walking ---

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind != TEXT and self.tokens[i].text in texts

    def word(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == WORD and not self.tokens[i].text[0].isdigit()

    def after(self, i: int) -> int:
        """The token after i, or after the bracket that closes it."""
        return self.close.get(i, i) + 1

    def angles(self, i: int, stop: int) -> int:
        """The token after the type parameters that begin at i; i where none do."""
        if not self.is_(i, "<"):
            return i
        depth, k = 0, i
        while k < stop:
            if self.is_(k, "<"):
                depth += 1
            elif self.is_(k, ">"):
                depth -= 1
                if not depth:
                    return k + 1
            elif self.is_(k, ";", "}"):
                return i
            k = self.after(k)
        return i

    def noted(self, i: int) -> int:
        """The first line of token i and of the comments before it."""
        return min([self.tokens[i].line, *self.notes[i]])
