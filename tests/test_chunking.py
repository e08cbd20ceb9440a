"""Windows, Markdown, blocks, declarations."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeseek.functions.code_nodes import EXTRACTORS, java, kotlin, typescript
from lodeseek.operators import chunking as C
from lodeseek.plans import code_shapes

LINES = st.lists(st.text("ab ", max_size=12), min_size=1, max_size=40)


@given(LINES, st.integers(1, 40), st.integers(0, 20))
@settings(max_examples=200, deadline=None)
def test_windows_cover_and_bound(lines, most, overlap):
    w = C.windows(lines, most, overlap)
    assert w[0][0] == 0 and w[-1][1] == len(lines)
    for (a, b), (c, d) in zip(w, w[1:]):
        assert a <= c < b < d
        kept = sum(len(x) + 1 for x in lines[c:b])
        assert b - c == 1 or kept <= overlap
    for a, b in w:
        new = [x for x in lines[a:b]]
        assert len("\n".join(new)) <= most or b - a <= 2 or overlap > 0


@given(st.text("ab\n", max_size=200), st.integers(1, 5))
@settings(max_examples=200, deadline=None)
def test_fixed_chunks_are_slices(text, tokens):
    chunks = C.FixedChunker(tokens, 1).chunks("x", text)
    assert bool(chunks) == bool(text)
    for c in chunks:
        assert text[c["start_offset"] : c["end_offset"]] == c["content"]


def test_small_file_is_one_chunk():
    assert C.FixedChunker().chunks("x", "ab")[0] == dict(content="ab", source_type="text", start_offset=0, end_offset=2)
    assert C.FixedChunker().chunks("x", "") == []


def test_markdown():
    text = "pre\n# A\nx\n## B\n### C\ny\n## D\n \n# E\r\nz"
    got = [(c["header_path"], c["header_level"], c["start_line"], c["end_line"]) for c in C.MarkdownChunker().chunks("a.md", text)]
    assert got == [(None, None, 1, 1), ("# A", 1, 2, 3), ("# A > ## B", 2, 4, 4), ("# A > ## B > ### C", 3, 5, 6), ("# A > ## D", 2, 7, 8), ("# E", 1, 9, 10)]


def test_markdown_long_section_keeps_its_path():
    got = C.MarkdownChunker(5, 1).chunks("a.md", "# A\n" + "\n".join(["word word"] * 6))
    assert len(got) > 1 and {c["header_path"] for c in got} == {"# A"} and got[0]["start_line"] == 1


def test_builtin_sections_are_the_same(spark):
    texts = [("a", "pre\n# A\nx\n## B\n### C\ny\n## D\n \n# E\r\nz"), ("b", "# only"), ("c", "no heading"), ("d", "### deep\nx\n# top\n## low\n# \n#x")]
    df = spark.createDataFrame(texts, "path string, content string")
    got = sorted((r.path, r.ordinal, r.header_path, r.header_level, r.start_line, r.end_line, r.content) for r in C.markdown_sections(df).collect())
    want = sorted((p, i, c["header_path"], c["header_level"], c["start_line"], c["end_line"], c["content"]) for p, t in texts for i, c in enumerate(C.MarkdownChunker().chunks(p, t)))
    assert got == want


def test_blocks():
    text = "a\n\nb\n\n\n\nc\n  \n\nd"
    got = [(c["content"], c["start_line"], c["end_line"]) for c in C.BlockChunker().chunks("x.py", text)]
    assert got == [("a\nb\n\nc\n\nd", 1, 10)]
    got = [(c["content"], c["start_line"], c["end_line"]) for c in C.BlockChunker(1, 0).chunks("x.py", text)]
    assert got == [("a\nb\n\nc", 1, 7), ("d", 10, 10)]  # blocks of 3 + 1 characters fit into 4, the joint isn't counted


def test_java():
    code = "package a.b;\n\n/** doc */\n@Anno\npublic class C {\n  int x = 1;\n  C() { }\n  public int get(int a) {\n    return 1; // }\n  }\n  class In { void m() {} }\n}\n"
    got = {(n.fragment_type, n.fqn, n.subtype) for n in java(code)}
    assert ("CLASS", "a.b.C", None) in got and ("METHOD", "a.b.C.get", None) in got and ("METHOD", "a.b.C.C", "CONSTRUCTOR") in got and ("METHOD", "a.b.C.In.m", None) in got
    assert ("CLASS", "a.b.C.In", None) not in got
    assert next(n for n in java(code) if n.fqn == "a.b.C").start_line == 3
    assert {(n.fragment_type, n.subtype) for n in java("record R(int a) {}\n@interface X {}\nenum E { A }")} == {("CLASS", "RECORD"), ("INTERFACE", "ANNOTATION_TYPE"), ("ENUM", None)}


def test_typescript():
    code = 'export class A {\n  private x = 1;\n  run(a: string): void {\n    const s = "}";\n  }\n}\nexport const f = () => { return 1; };\nfunction* g() {}\nexport interface I { a: string }\nexport type T = string | number;\ntype Hidden = string;\nenum E { A }\nnamespace N {\n  export function inner() {}\n}\n'
    got = {(n.fragment_type, n.fqn) for n in typescript(code)}
    assert got == {("CLASS", "A"), ("METHOD", "A.run"), ("FUNCTION", "f"), ("FUNCTION", "g"), ("INTERFACE", "I"), ("TYPE", "T"), ("ENUM", "E"), ("FUNCTION", "inner")}
    assert len(typescript("export const myArrow = () => { return 1; };")) == 1


def test_kotlin():
    code = "package p\n\nval a = 1\nval b: Int = 2\ndata class D(val x: Int)\nsealed class S {\n  companion object { fun make() = 1 }\n  fun m(): Int {\n    return 1\n  }\n}\nobject O { fun z() {} }\nfun String.twice(): String = this + this\nfun plain() {}\nenum class E { A }\n"
    got = {(n.fragment_type, n.fqn, n.subtype, n.receiver) for n in kotlin(code)}
    assert ("CLASS", "p.D", "DATA_CLASS", None) in got and ("CLASS", "p.S", "SEALED_CLASS", None) in got and ("CLASS", "p.S.Companion", "COMPANION_OBJECT", None) in got
    assert ("METHOD", "p.S.m", None, None) in got and ("CLASS", "p.O", "OBJECT", None) in got and ("FUNCTION", "p.twice", "EXTENSION_FUNCTION", "String") in got
    assert ("ENUM", "p.E", None, None) in got and kotlin(code)[-1].fqn == "p._properties_3" and kotlin(code)[-1].subtype == "PROPERTIES"


@pytest.mark.parametrize("language,shapes", [("typescript", code_shapes.TYPESCRIPT), ("java", code_shapes.JAVA), ("kotlin", code_shapes.KOTLIN)])
def test_shapes_of_code(language, shapes):
    """Templates, regular expressions, text blocks, generics, nested comments, overloads, anonymous classes, accessors, broken code."""
    assert len(shapes) >= 20
    for code, held in shapes:
        code = re.sub(r"(?<=\w)@", "7", code)
        want = [(kind, name.replace("@", "7"), a, b, sub, receiver and receiver.replace("@", "7")) for kind, name, a, b, sub, receiver in code_shapes.declared(held)]
        assert [(n.fragment_type, n.fqn, n.start_line, n.end_line, n.subtype, n.receiver) for n in EXTRACTORS[language](code)] == want, code
        # Windows line ends and what stands before don't matter.
        assert [(n.fqn, n.start_line - 2, n.end_line - 2) for n in EXTRACTORS[language]("\r\n;\r\n" + code.replace("\n", "\r\n"))] == [(w[1], w[2], w[3]) for w in want] or "package" in code


def test_any_text_ends():
    """Random pieces of code, cut and mixed: readers end, and lines lie in the text and in order."""
    rng = random.Random(7)
    bits = ["class ", "fun ", "{", "}", "(", ")", "<", ">", "`", '"', "'", '"""', "${", "/", "//", "/*", "*/", "\n", ";", "=", "=>", "->", "@", "@A(", "x", " y ", "new ", "val ", "get()", "const ", "interface ", "enum ", "package p", "companion object", ",", ":", ".", "?.", "[", "]", "\\", "import z", "namespace N", "record R", "type T ="]
    for k in range(1500):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(60)))
        if k % 3 == 0:
            code = rng.choice(rng.choice([code_shapes.TYPESCRIPT, code_shapes.JAVA, code_shapes.KOTLIN]))[0]
            at = rng.randrange(len(code))
            text = code[: at] + text + code[at + rng.randrange(8) :]
        for language in ("typescript", "java", "kotlin"):
            for n in EXTRACTORS[language](text):
                assert 1 <= n.start_line <= n.end_line <= text.count("\n") + 1 and n.fqn


def test_deep_and_long_code():
    for text in ("(" * 20_000, "{" * 20_000 + ")" * 20_000, "([{" * 9_000 + "}])" * 9_000, "`${" * 500, "class A {" * 300, "'" * 20_000, "/*" * 9_000, "x<" * 9_000):
        for language in ("typescript", "java", "kotlin"):
            EXTRACTORS[language](text)


def test_dispatch_and_ordinals(spark):
    df = spark.createDataFrame([("a.md", "# A\nx\n# B\ny"), ("b.txt", "t"), ("c.py", "x"), ("d.java", "class C {}"), ("e.txt", None), ("f.txt", "")], "path string, content string")
    rows = C.chunked(df).collect()
    assert {(r.path, r.ordinal, r.source_type) for r in rows} == {("a.md", 0, "markdown"), ("a.md", 1, "markdown"), ("b.txt", 0, "text"), ("c.py", 0, "code"), ("d.java", 0, "code")}


def brute_blocks(text, most):
    """Chunks of a text without blocks longer than `most`: runs of lines between two or more blank ones, joined while they fit."""
    blocks, lines = [[]], text.split("\n")
    for i, line in enumerate(lines):
        if line.strip():
            if blocks[-1] and i >= 2 and not lines[i - 1].strip() and not lines[i - 2].strip():
                blocks.append([])
            blocks[-1].append(line)
    out = []
    for b in ("\n".join(b) for b in blocks if b):
        if out and sum(map(len, out[-1])) + len(out[-1]) - 1 + len(b) <= most:
            out[-1].append(b)
        else:
            out.append([b])
    return ["\n\n".join(x) for x in out]


@given(st.text("ab \n", max_size=120))
@settings(max_examples=300, deadline=None)
def test_blocks_by_brute_force(text):
    if max((len(x) for x in brute_blocks(text, 0)), default=0) <= 40:
        assert [c["content"] for c in C.BlockChunker(10, 1).chunks("a.py", text)] == brute_blocks(text, 40)
