import sqlite3

import pytest
from pyspark.sql import functions as F

from loomstack.functions import text as T
from loomstack.operators import bm25, chunking, fusion, symbols


def test_bm25_equals_the_full_text_engine(spark):
    docs = [(i, t) for i, t in enumerate(["load user stats now", "load_user_stats", "user load stats", "stats stats user", "nothing here", "the user loads", "Stats of a user load user stats"])]
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table f using fts5(body, tokenize='unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text engine here")
    for i, t in docs:
        db.execute("insert into f(rowid, body) values (?, ?)", (i + 1, " ".join(T.py_tokens(t, query=False))))
    index = spark.createDataFrame(docs, "id long, t string").select("id", T.terms(T.tokens(F.col("t"))).alias("body_terms"))
    for q in ("user stats", "load_user_stats", "nothing"):
        match = " AND ".join(f'"{t}"' for t in T.py_tokens(q))
        want = {r[0] - 1: round(r[1], 9) for r in db.execute("select rowid, bm25(f) from f where f match ?", (match,))}
        got = {r.id: round(r.score, 9) for r in bm25.scored(index, T.query_phrases(q), {"body_terms": 1.0}).collect()}
        assert got == want


def test_empty_phrase_and_fallback(spark):
    index = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"])], "id long, body_terms array<string>")
    assert bm25.scored(index, [[]], {"body_terms": 1.0}).count() == 0
    assert {r.id for r in bm25.search(index, "a c", {"body_terms": 1.0}, ["id"], 5).collect()} == {1, 2}
    assert bm25.search(index, "absent", {"body_terms": 1.0}, ["id"], 5).count() == 0


def test_windows():
    plain = "\n".join(f"l{i}" for i in range(200)) + "\n"
    assert [(a, b) for a, b, _ in chunking.split(plain)] == [(1, 80), (71, 150), (141, 200)]
    gap = [f"l{i}" for i in range(100)]
    gap[60] = ""
    assert [(a, b) for a, b, _ in chunking.split("\n".join(gap))] == [(1, 61), (52, 100)]
    assert chunking.split("") == [] and [c[:2] for c in chunking.split("a\r\nb\rc")] == [(1, 3)]
    eighty = ["x"] * 80
    eighty[70] = " "
    assert [(a, b) for a, b, _ in chunking.split("\n".join(eighty))][0] == (1, 71)
    assert len(chunking.split("y" * 70_000)[0][2].encode()) == 16 << 10


def test_windows_always_advance_and_cover():
    import random

    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(1, 60)
        blank = sorted(rng.sample(range(n), rng.randint(0, n)))
        w = list(chunking.windows(blank, n, rng.randint(1, 12), rng.randint(0, 14)))
        assert w[0][0] == 0 and w[-1][1] == n and all(a < c <= b for (a, b), (c, d) in zip(w, w[1:]))


@pytest.mark.parametrize("path,text,want", [
    ("a.py", "class A:\n    def m(self):\n        pass\n\nasync def f(): pass\n", [("A", "class", 1), ("m", "function", 2), ("f", "function", 5)]),
    ("a.go", "package x\n\nfunc Foo(a int) {\n}\nfunc (r *T) Bar() {\n}\ntype T struct {\n}\n", [("Foo", "function", 3), ("Bar", "method", 5), ("T", "type", 7)]),
    ("a.gd", "class_name W\nsignal hit\nconst K = 1\nfunc go():\n\tpass\n", [("W", "class", 1), ("hit", "signal", 2), ("K", "constant", 3), ("go", "function", 4)]),
    ("a.rb", "module M\n  class A::B\n    def x?\n    end\n  end\nend\n", [("M", "module", 1), ("B", "class", 2), ("x?", "method", 3)]),
    ("a.js", "export class A {\n  m(x) {\n  }\n}\nconst f = (a) => a\nfunction* g() {}\n", [("A", "class", 1), ("m", "method", 2), ("f", "function", 5), ("g", "function", 6)]),
    ("a.ts", "interface I {\n}\ntype T = string\nabstract class C {\n}\n", [("I", "interface", 1), ("T", "type", 3), ("C", "class", 4)]),
    ("a.txt", "def x(): pass", []), ("bad.py", "def broken(:\n  pass", [("broken", "function", 1)]), ("n.py", None, [])])
def test_symbols(path, text, want):
    got = symbols.extract(path, text)
    assert [(n, k, a) for n, k, a, _, _ in got] == want and all(b >= a for _, _, a, b, _ in got)


def test_language_switches():
    assert symbols.enabled(None) == frozenset(symbols.LANGUAGES) and symbols.enabled([]) == frozenset() and "tsx" in symbols.enabled(["typescript"])
    for bad in (["cobol"], ["go", "go"], [""]):
        with pytest.raises(ValueError):
            symbols.enabled(bad)
    assert symbols.fingerprint(frozenset(["go"])) != symbols.fingerprint(frozenset(["go", "ruby"]))


def test_fusion(spark):
    c = spark.createDataFrame([("a.py", 1, 80, -9.0, "chunk body\nof a"), ("a.py", 71, 150, -8.0, "second"), ("b.py", 1, 10, -7.0, "other")], "path string, start_line int, end_line int, score double, snippet string")
    s = spark.createDataFrame([("a.py", 40, 45, -3.0, "def handle", "handle"), ("c.py", 5, 6, -2.0, "def x", "x")], "path string, start_line int, end_line int, score double, snippet string, name string")
    got = fusion.fuse(c, s, "m.handle").collect()
    assert (got[0].path, got[0].start_line, got[0].end_line, got[0].snippet) == ("a.py", 40, 150, "chunk body\nof a")
    assert abs(got[0].score - (1 / 61 + 1 / 62 + 2 / 61 + 1 / 30)) < 1e-12
    assert {r.path for r in got} == {"a.py", "b.py", "c.py"}


def test_chunk_only_caps_and_near_overlaps(spark):
    h = spark.createDataFrame([("a", 1, 50, -9.0, "x"), ("a", 5, 60, -8.0, "y"), ("a", 100, 120, -7.0, "z"), ("a", 300, 310, -6.0, "w"), ("b", 1, 2, -5.0, "k" * 500)], "path string, start_line int, end_line int, score double, snippet string")
    got = fusion.chunk_only(h).collect()
    assert [(r.path, r.start_line) for r in got] == [("a", 1), ("a", 100), ("b", 1)] and got[-1].snippet == "k" * 400 + "…"


@pytest.mark.parametrize("k,want", [(0, 10), (-1, 10), (7, 7), (99, 50)])
def test_clamp(k, want):
    assert fusion.clamp_top_k(k) == want


def test_texts_of_a_place():
    from collections import namedtuple

    hit = namedtuple("hit", "start_line end_line snippet from_symbol name gain")
    chunk = lambda t, a=1, b=80: hit(a, b, t, False, None, 1.0)
    symbol = lambda t, a=10, b=12: hit(a, b, t, True, f"s{a}", 2.0)

    def place(*hits):
        p = fusion.Place(hits[0])
        p.hits += hits[1:]
        return p

    assert place(chunk("first"), chunk("second\nlonger"), symbol("def f")).text() == "first"
    assert place(chunk(" "), chunk("second"), symbol("def f")).text() == "second" and place(chunk(None), symbol("def f")).text() == "def f"
    assert place(symbol("def f"), symbol("def g(a)")).text() == "def g(a)" and place(symbol("ab"), symbol("cd")).text() == "ab" and place(symbol(None)).text() == ""
    assert place(chunk("body"), symbol("a\nb\nc"), symbol("x\ny")).text() == "x\ny"  # only a further symbol takes a chunk's place
    assert place(chunk("b", 5, 80), symbol("f", 30, 90), symbol("g", 20, 25)).span() == (30, 90) and place(chunk("b", 5, 80), chunk("c", 2, 9)).span() == (2, 80)
    assert place(chunk("b"), symbol("f")).row("p") == ("p", 10, 80, 3.0, "b", "s10")


@pytest.mark.parametrize("a,b,want", [("", "x", False), ("x", "", True), ("a\nb", "long line", True), ("abc", "ab", True), ("ab", "ab", False), (None, " ", False)])
def test_richness(a, b, want):
    assert (fusion.richness(a) > fusion.richness(b)) is want
