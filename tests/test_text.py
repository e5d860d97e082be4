import pytest
from pyspark.sql import functions as F

from loomstack.functions import text as T

STAGE1 = [
    ("getUserProfile", ["getuserprofile", "get", "user", "profile"]), ("HTTPServer2Go", ["httpserver2go", "http", "server", "2", "go"]), ("load_user_stats", ["load_user_stats", "load", "user", "stats"]),
    ("parseJSONValue", ["parsejsonvalue", "parse", "json", "value"]), ("有効期限", ["有効期限", "有効", "効期", "期限"]), ("the the The", ["the"]), ("", []), ("a", ["a"]),
    ("InputManager.handle", ["inputmanager::handle", "inputmanagerhandle", "inputmanager.handle", "inputmanager", "input", "manager", "handle"]), ("サーバー", ["サ", "ー", "バ"]), ("x_y1Z", ["x_y1z", "x", "y1z", "y", "1", "z"]),
]


@pytest.mark.parametrize("text,want", STAGE1)
def test_stage1_column_and_twin(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(T.tokens(F.col("t")).alias("x")).first().x
    assert got == want
    assert T.py_tokens(text, query=False) == want


def test_query_mode(spark):
    assert T.py_tokens("有効期限") == ["有効", "効期", "期限"]
    assert T.py_tokens("A::b") == ["ab", "a", "b"]
    q = spark.createDataFrame([("有効期限 A::b",)], "t string").select(T.tokens(F.col("t"), query=True).alias("x")).first().x
    assert q == T.py_tokens("有効期限 A::b")


def test_stage2_and_phrases(spark):
    df = spark.createDataFrame([("Éaueux ñandú straße x_y",)], "t string")
    assert df.select(T.terms(T.tokens(F.col("t"))).alias("x")).first().x == ["eaueux", "nandu", "straße", "x", "y", "x", "y"]
    assert T.query_phrases("load_user") == [["load", "user"], ["load"], ["user"]]
    assert T.query_phrases("_") == [[]]


def test_paths(spark):
    df = spark.createDataFrame([("app\\models/getUser-x.test.go",)], "p string")
    r = df.select(T.path_terms(F.col("p")).alias("a"), T.basename_terms(F.col("p")).alias("b")).first()
    assert r.a == ["app", "models", "getuser", "get", "user", "x", "test", "go"]
    assert r.b[-1] == "go" and "app" not in r.b


@pytest.mark.parametrize("q,want", [("SessionStore", "SessionStore"), ("a.b::c/d", "a.b::c/d"), ("func handle", "handle"), ("class_name X", "X"), ("two words", None), ("", None), ("a-b", None), ("..", None)])
def test_identifier_like(q, want):
    assert T.symbol_token(q) == want
