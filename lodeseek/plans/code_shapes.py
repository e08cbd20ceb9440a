"""Pieces of code with the declarations they have, for the queries on code; @ stands for a number of the row.

A declaration: kind, name, lines, and where it has them a subtype and a receiver.
"""

from __future__ import annotations

TYPESCRIPT = [
    ("export class A@ {\n  m(): number {\n    return 1;\n  }\n}\n", "CLASS A@ 1-5; METHOD A@.m 2-4"),
    ("const f@ = () => 1;\nlet g@ = async (x: number): Promise<void> => {\n  await x;\n};\n", "FUNCTION f@ 1-1; FUNCTION g@ 2-4"),
    ("interface I@ { x: number }\nexport interface J@ extends I@ {\n  y: { z: string };\n}\n", "INTERFACE I@ 1-1; INTERFACE J@ 2-4"),
    ("export type T@ = string | { a: number };\ntype Hidden@ = number;\n", "TYPE T@ 1-1"),
    ("enum E@ { X, Y = 'a}' }\nexport const enum F@ {\n  Z\n}\n", "ENUM E@ 1-1; ENUM F@ 2-4"),
    ("function* saga@() {\n  yield 1;\n}\nexport async function run@<T extends { a: 1 }>(x: T): Promise<{ b: T }> {\n  return { b: x };\n}\n", "FUNCTION saga@ 1-3; FUNCTION run@ 4-6"),
    ("const s@ = `a ${ x ? `}` : '{' } {`;\nfunction after@() { return s@; }\n", "FUNCTION after@ 2-2"),
    ("const re@ = /[{/]+\\/{2}/g;\nfunction rx@() {\n  return /}/.test('a') ? 4 / 2 / 1 : 0;\n}\n", "FUNCTION rx@ 2-4"),
    ("namespace N@ {\n  export function inner@() {}\n  namespace M@.K { export class C@ { run() {} } }\n}\n", "FUNCTION inner@ 2-2; CLASS C@ 3-3; METHOD C@.run 3-3"),
    ("declare module 'mod@' {\n  export interface Opt@ { a: 1 }\n}\ndeclare class D@ { m(): void; n() {} }\n", "INTERFACE Opt@ 2-2; CLASS D@ 4-4; METHOD D@.n 4-4"),
    ("// about\n@Component({ selector: 'x{' })\nexport class Dec@ {\n  @Input() name = '';\n  @Output()\n  change = () => {};\n  constructor(private x: number) {}\n}\n", "CLASS Dec@ 3-8; METHOD Dec@.constructor 7-7"),
    ("class G@<T extends Map<string, T[]>> extends Base<T> implements X {\n  private static async *gen<U>(a: U): AsyncGenerator<U> {\n    yield a;\n  }\n  get v(): number { return 1 }\n  set v(x) {}\n}\n", "CLASS G@ 1-7; METHOD G@.gen 2-4; METHOD G@.v 5-5; METHOD G@.v 6-6"),
    ("class O@ {\n  over(a: string): void;\n  over(a: number): void;\n  over(a: any): void {}\n  #hidden() {}\n  ['com' + 'puted']() {}\n  field = function () { return 1; };\n}\n", "CLASS O@ 1-8; METHOD O@.over 4-4; METHOD O@.#hidden 5-5; METHOD O@.['com'+'puted'] 6-6"),
    ("export default class Def@ {}\nexport default function () {}\n", "CLASS Def@ 1-1"),
    ("const a@ = 1, b@ = () => 2, c@ = function* () {\n  yield 3;\n};\nvar old@ = () => 1;\n", "FUNCTION b@ 1-3; FUNCTION c@ 1-3"),
    ("const obj@ = {\n  m() {},\n  f: () => 1,\n};\nif (obj@) {\n  function cond() {}\n}\n{\n  function block@() {}\n}\n", "FUNCTION block@ 9-9"),
    ("const C@ = (props: { a: string }) => {\n  return <div className=\"x\">{props.a}</div>;\n};\nexport const useIt@ = <T,>(x: T) => x;\n", "FUNCTION C@ 1-3; FUNCTION useIt@ 4-4"),
    ("abstract class Abs@ {\n  abstract m(): void;\n  n(): void { /* } */ }\n}\nexport abstract class Bas@ { k() {} }\n", "CLASS Abs@ 1-4; METHOD Abs@.n 3-3; CLASS Bas@ 5-5; METHOD Bas@.k 5-5"),
    ("function over@(a: string): string\nfunction over@(a: number): number\nfunction over@(a: any) {\n  return a\n}\nconst h@ = a => a\nconst k@ = 5\n", "FUNCTION over@ 3-5; FUNCTION h@ 6-6"),
    ("function guard@(x: unknown): x is { a: 1 } {\n  return true;\n}\nclass S@ {\n  static { let y = () => {}; }\n  static async = 1;\n  async() {}\n}\n", "FUNCTION guard@ 1-3; CLASS S@ 4-8; METHOD S@.async 7-7"),
    ("import x from 'y';\n'use strict';\nlet text@ = \"it's {\";\nexport const long@ =\n  (a: number) =>\n    a + 1;\n", "FUNCTION long@ 4-6"),
]

JAVA = [
    ("package p.q;\n\n/** About it. */\npublic class C@ {\n  C@() { }\n  int m() {\n    return 1;\n  }\n}\n", "CLASS p.q.C@ 3-9; METHOD p.q.C@.C@ 5-5 CONSTRUCTOR; METHOD p.q.C@.m 6-8"),
    ("package p;\nrecord R@(int a, List<String> b) {\n  R@ { }\n  int sum() { return a; }\n}\n", "CLASS p.R@ 2-5 RECORD"),
    ("package p;\n@interface Note@ {\n  String value() default \"{\";\n}\npublic @interface Other@ {}\n", "INTERFACE p.Note@ 2-4 ANNOTATION_TYPE; INTERFACE p.Other@ 5-5 ANNOTATION_TYPE"),
    ("package p;\nenum E@ { A { int v() { return 1; } }, B; abstract int v(); }\n", "ENUM p.E@ 2-2"),
    ("package p;\npublic interface I@<T extends Comparable<? super T>> extends X, Y<T> {\n  default void m() { }\n}\n", "INTERFACE p.I@ 2-4"),
    ("package p;\nclass Outer@ {\n  class Inner { void deep() { } class Third { Third() { } } }\n  interface Not { default void no() { } }\n  enum Nor { A; void no() { } }\n}\n", "CLASS p.Outer@ 2-6; METHOD p.Outer@.Inner.deep 3-3; METHOD p.Outer@.Inner.Third.Third 3-3 CONSTRUCTOR"),
    ("package p;\nclass T@ {\n  String s = \"\"\"\n    } \"quoted\" {\n    \"\"\";\n  char c = '}';\n  void m() { }\n}\n", "CLASS p.T@ 2-8; METHOD p.T@.m 7-7"),
    ("package p;\n// one\n/* two */\n@Deprecated\n@SuppressWarnings({\"a\", \"b\"})\nfinal class A@ { }\n", "CLASS p.A@ 2-6"),
    ("package p;\nclass G@ {\n  <T extends List<? super T>> Map<String, int[]> gen(T a, Map<T, T> b) throws X, Y {\n    return null;\n  }\n  public <U> G@(U u) { }\n}\n", "CLASS p.G@ 2-7; METHOD p.G@.gen 3-5; METHOD p.G@.G@ 6-6 CONSTRUCTOR"),
    ("package p;\nabstract class Abs@ {\n  abstract int m(int a);\n  native void n();\n  int[] arr() [] { return null; }\n}\n", "CLASS p.Abs@ 2-6; METHOD p.Abs@.m 3-3; METHOD p.Abs@.n 4-4; METHOD p.Abs@.arr 5-5"),
    ("package p;\nclass Anon@ {\n  Runnable r = new Runnable() {\n    public void run() { }\n  };\n  int x = 1, y = f(2);\n}\n", "CLASS p.Anon@ 2-7; METHOD p.Anon@.run 4-4"),
    ("package p;\nclass Init@ {\n  static { new X<String>(1) { void z() { } }; }\n  { int q = 0; }\n  void last() { class Local { void no() { } } }\n}\n", "CLASS p.Init@ 2-6; METHOD p.Init@.z 3-3; METHOD p.Init@.last 5-5"),
    ("package p;\npublic sealed interface S@ permits X, Y { }\nnon-sealed class X implements S@ { }\nfinal class Y implements S@ { }\n", "INTERFACE p.S@ 2-2; CLASS p.X 3-3; CLASS p.Y 4-4"),
    ("import java.util.*;\nclass NoPackage@ {\n  static int f(int... a) { return a.length; }\n}\n", "CLASS NoPackage@ 2-4; METHOD NoPackage@.f 3-3"),
    ("package p;\nclass Lambda@ {\n  Function<A, B> f = a -> {\n    return new B() { int k() { return 1; } };\n  };\n  Supplier<C> s = C::new;\n  void m() { }\n}\n", "CLASS p.Lambda@ 2-8; METHOD p.Lambda@.k 4-4; METHOD p.Lambda@.m 7-7"),
    ("package p;\nclass Doc@ {\n  /**\n   * With { and @see.\n   */\n  @Override\n  public String toString() {\n    return \"x\";\n  }\n\n  // next\n  void next() { }\n}\n", "CLASS p.Doc@ 2-13; METHOD p.Doc@.toString 3-9; METHOD p.Doc@.next 11-12"),
    ("package p;\nclass Ann@ {\n  @A(x = {1, 2}, y = @B(\"}\")) private @Nullable String s() { return null; }\n}\n", "CLASS p.Ann@ 2-4; METHOD p.Ann@.s 3-3"),
    ("package p;\nclass First@ { }\nclass Second@ extends First@ {\n  Second@() {\n    super();\n  }\n}\n", "CLASS p.First@ 2-2; CLASS p.Second@ 3-7; METHOD p.Second@.Second@ 4-6 CONSTRUCTOR"),
    ("package p;\nclass Sync@ {\n  protected static final synchronized void a() { if (b < c && d > (e)) { } }\n  private volatile boolean flag;\n  record Pair(int l, int r) { int s() { return l; } }\n}\n", "CLASS p.Sync@ 2-6; METHOD p.Sync@.a 3-3"),
    ("package p;\nclass Broken@ {\n  void ok() { }\n  int = ;\n  void fine() { foo(; }\n}\n", "CLASS p.Broken@ 2-6; METHOD p.Broken@.ok 3-3; METHOD p.Broken@.fine 5-5"),
]

KOTLIN = [
    ("package p\nclass D@ {\n  fun m(): Int { return 1 }\n}\nfun String.plus(): String = this\nval x = 1\n", "CLASS p.D@ 2-4; METHOD p.D@.m 3-3; FUNCTION p.plus 5-5 EXTENSION_FUNCTION String; FUNCTION p._properties_6 6-6 PROPERTIES"),
    ("package p\ndata class Point@(val x: Int, val y: List<Pair<Int, Int>> = listOf())\nsealed class Res@\nclass Plain@\n", "CLASS p.Point@ 2-2 DATA_CLASS; CLASS p.Res@ 3-3 SEALED_CLASS; CLASS p.Plain@ 4-4"),
    ("package p\nobject Single@ {\n  fun go() = 1\n}\ndata object Unit@\n", "CLASS p.Single@ 2-4 OBJECT; METHOD p.Single@.go 3-3; CLASS p.Unit@ 5-5 OBJECT"),
    ("package p\nclass Has@ {\n  companion object {\n    fun make(): Has@ = Has@()\n  }\n}\nclass Named@ { companion object Factory { fun of() {} } }\n", "CLASS p.Has@ 2-6; CLASS p.Has@.Companion 3-5 COMPANION_OBJECT; METHOD p.Has@.Companion.make 4-4; CLASS p.Named@ 7-7; CLASS p.Named@.Factory 7-7 COMPANION_OBJECT; METHOD p.Named@.Factory.of 7-7"),
    ("package p\nenum class Color@(val rgb: Int) {\n  RED(1) { override fun v() = 1 },\n  BLUE(2);\n  open fun v() = 0\n}\n", "ENUM p.Color@ 2-6; METHOD p.Color@.v 3-3; METHOD p.Color@.v 5-5"),
    ("package p\ninterface Shape@ {\n  val area: Double\n  fun draw()\n  fun twice() { draw(); draw() }\n}\nfun interface Sam@ { fun invoke(x: Int): Int }\n", "INTERFACE p.Shape@ 2-6; METHOD p.Shape@.draw 4-4; METHOD p.Shape@.twice 5-5; INTERFACE p.Sam@ 7-7; METHOD p.Sam@.invoke 7-7"),
    ("package p\nfun <T> List<T>.second(): T = this[1]\nfun <T : Comparable<T>> top@(a: T) where T : Any {\n  println(a)\n}\n", "FUNCTION p.second 2-2 EXTENSION_FUNCTION List<T>; FUNCTION p.top@ 3-5"),
    ("package p\nval a = 1\nval b: Int = 2\nfun f@() {}\nvar c = 3\n// between\nconst val d = 4\n", "FUNCTION p.f@ 4-4; FUNCTION p._properties_2 2-3 PROPERTIES; FUNCTION p._properties_5 5-5 PROPERTIES; FUNCTION p._properties_7 7-7 PROPERTIES"),
    ("package p\n/** Doc /* nested { */ still. */\nclass Note@ {\n  // one\n  /* two */\n  @Test fun t() {}\n}\n", "CLASS p.Note@ 2-7; METHOD p.Note@.t 4-6"),
    ("package p\nclass Str@ {\n  val s = \"a ${ if (x) \"}\" else \"{\" } \\\" {\"\n  val t = \"\"\"raw } \"x\" { ${y} \"\"\"\n  fun m() {}\n}\n", "CLASS p.Str@ 2-6; METHOD p.Str@.m 5-5"),
    ("package p\nclass Outer@ {\n  inner class In { fun deep() {} }\n  interface Sub { fun low() }\n  object Ob { fun obj() {} }\n}\n", "CLASS p.Outer@ 2-6; METHOD p.Outer@.In.deep 3-3; METHOD p.Outer@.Sub.low 4-4; METHOD p.Outer@.Ob.obj 5-5"),
    ("package p\nclass Ctor@ private constructor(\n  private val a: Int,\n) : Base(a), Other by a {\n  init { println(a) }\n  constructor() : this(1) { }\n  fun k(): Unit = Unit\n}\n", "CLASS p.Ctor@ 2-8; METHOD p.Ctor@.k 7-7"),
    ("package p\nval lazyOne@: String by lazy {\n  \"x\"\n}\nval size@: Int\n  get() = 1\nvar held@ = 0\n  private set\n  get() {\n    return field\n  }\nfun g@() = 2\n", "FUNCTION p.g@ 12-12; FUNCTION p._properties_2 2-11 PROPERTIES"),
    ("package p\nsuspend inline fun run@(\n  crossinline block: suspend () -> Unit,\n): Int =\n  if (x) 1\n  else 2\nfun last@(): Map<String, () -> Unit> {\n  return mapOf()\n}\n", "FUNCTION p.run@ 2-6; FUNCTION p.last@ 7-9"),
    ("import a.b.C\nclass NoPackage@\nfun main@() = println(\"hi\")\n", "CLASS NoPackage@ 2-2; FUNCTION main@ 3-3"),
    ("package a.b.c\ntypealias Name@ = List<String>\nabstract class Abs@<T : Any>(x: T) {\n  abstract fun m(x: T)\n  protected open fun n(): T? = null\n}\n", "CLASS a.b.c.Abs@ 3-6; METHOD a.b.c.Abs@.m 4-4; METHOD a.b.c.Abs@.n 5-5"),
    ("package p\noperator fun Vec@.plus(o: Vec@) = Vec@(x + o.x)\ninfix fun Int.at@(o: Int): Int {\n  return this\n}\nfun String?.orNone@() = this ?: \"\"\n", "FUNCTION p.plus 2-2 EXTENSION_FUNCTION Vec@; FUNCTION p.at@ 3-5 EXTENSION_FUNCTION Int; FUNCTION p.orNone@ 6-6 EXTENSION_FUNCTION String?"),
    ("package p\n@Anno(\"{\")\n@file.Other\ninternal annotation class Mark@(val v: String)\n@JvmInline\nvalue class Wrap@(val s: String)\n", "CLASS p.Mark@ 2-4; CLASS p.Wrap@ 5-6"),
    ("package p\nclass Gen@ {\n  fun `spaced name`() {}\n  private val cb = object : Call { override fun no() {} }\n  fun outer() {\n    fun local() {}\n  }\n}\n", "CLASS p.Gen@ 2-8; METHOD p.Gen@.`spaced name` 3-3; METHOD p.Gen@.outer 5-7"),
    ("package p\nsealed interface Ev@ {\n  data class Click(val x: Int) : Ev@ { fun c() {} }\n  object Close : Ev@\n}\nval handler@ = { e: Ev@ ->\n  println(e)\n}\n", "INTERFACE p.Ev@ 2-5; METHOD p.Ev@.Click.c 3-3; FUNCTION p._properties_6 6-8 PROPERTIES"),
]


def declared(text: str) -> list[tuple[str, str, int, int, str | None, str | None]]:
    """(kind, name, first line, last line, subtype, receiver) of the declarations of a piece."""
    out = []
    for part in text.split("; "):
        kind, rest = part.split(" ", 1)
        name, lines, *more = rest.rsplit(" ", 1) if rest[-1].isdigit() else _split(rest)
        first, last = map(int, lines.split("-"))
        out.append((kind, name, first, last, *(more + [None, None])[:2]))
    return out


def _split(rest: str) -> list[str]:
    words = rest.split(" ")
    at = next(i for i in range(len(words) - 1, -1, -1) if words[i][0].isdigit())
    return [" ".join(words[:at]), *words[at:]]
