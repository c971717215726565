import pytest
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import corpus


def one(spark, expr, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)) if names else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("words,expected", [("a b c d", []), ("a b c d e", ["a b c d e"]), ("A b, c; d-e", ["a b c d e"]), (" ".join("abcdeabcde"), None), (None, []), ("", [])])
def test_shingles(spark, words, expected):
    got = one(spark, text.shingle_set(F.col("t")), t=words)
    assert got == expected if expected is not None else len(got) == 5  # repeated shingles collapse


def test_words_of_other_scripts(spark):
    assert one(spark, text.words(F.col("t")), t="Été_1 naïve 日本") == ["été_1", "naïve", "日本"]


def test_digests(spark):
    import hashlib

    ids = [1, 256, 70000]
    expected = hashlib.sha256(b"".join(x.to_bytes(4, "big") for x in ids)).hexdigest()
    assert spark.range(1).select(text.token_ids_digest(F.array(*map(F.lit, ids)))).first()[0] == expected
    doc = '{"b": 1, "a": "é"}'
    assert one(spark, text.json_digest(F.col("t")), t=doc) == hashlib.sha256('{"a": "é", "b": 1}'.encode()).hexdigest()
    assert text.canonical_json({"b": 1, "a": 2}, compact=True) == '{"a":2,"b":1}'
    with pytest.raises(ValueError):
        text.canonical_json(float("nan"))


def test_first_present_treats_empty_as_missing(spark):
    df = spark.createDataFrame([("", "x"), (None, ""), ("a", "b")], "a string, b string")
    assert [r[0] for r in df.select(text.first_present(F.col("a"), F.col("b"))).collect()] == ["x", None, "a"]


def test_bytes_label(spark):
    df = spark.createDataFrame([(0,), (1023,), (1536,), (5 << 40,)], "n long")
    assert [r[0] for r in df.select(text.bytes_label(F.col("n"))).collect()] == ["0.00 B", "1023.00 B", "1.50 KiB", "5.00 TiB"]


def test_budget_take(spark, rows):
    df = spark.createDataFrame([(i, "s", 10, f"{i:02x}") for i in range(10)] + [(99, "t", 5, "00")], "id long, source string, n long, k string")
    take = lambda target: rows(corpus.budget_take(df, target, "n", [F.col("k")], ["source"]), "id")
    assert take(25) == [(0,), (1,), (2,), (99,)]  # the row that crosses the target is kept
    assert take(30) == [(0,), (1,), (2,), (99,)]
    assert take(0) == []


def test_extract_text(spark):
    m = "array<struct<role:string,content:string>>"
    df = spark.createDataFrame([([("user", "hi"), (None, "yo"), ("x", "")], "t", "a", "b"), (None, "t", "a", "b"), ([], "  ", "a", "b"), (None, None, "a", " "), (None, None, " ", "b")], f"m {m}, t string, a string, b string")
    got = [r[0] for r in df.select(corpus.extract_text(F.col("m"), F.col("t"), None, F.col("a"), F.col("b"))).collect()]
    assert got == ["user: hi\nunknown: yo", "t", "a\nb", "a", None]


def test_prefix_and_splits(spark):
    df = spark.createDataFrame([([5, 20, 30, 90],), ([90],), ([],), ([5],)], "n array<int>")
    assert [r[0] for r in df.select(corpus.longest_prefix(F.col("n"), 10, 50)).collect()] == [30, None, None, None]
    df = spark.createDataFrame([(["test", "train_sft"],), (["b", "a"],), ([],)], "s array<string>")
    assert [r[0] for r in df.select(corpus.preferred_split(F.col("s"))).collect()] == ["train_sft", "b", None]


def test_issue_prompt_and_heldout(spark, rows):
    i = "array<struct<title:string,body:string>>"
    df = spark.createDataFrame([([("a", "b"), (None, "c")], "t", "u"), ([], "t", "u")], f"i {i}, t string, u string")
    assert [r[0] for r in df.select(corpus.issue_prompt(F.col("i"), F.col("t"), F.col("u"))).collect()] == ["a\nb\n\nc", "t\nu"]
    held = spark.createDataFrame([("x", None, "p", "", "t"), ("", "", "q", None, None)], "task_id string, name string, prompt string, sol string, tests string")
    assert rows(corpus.heldout_case("s", held, ["task_id", "name"], "prompt", ["sol", "tests"])) == [("s", "0", "q", ""), ("s", "x", "p", "t")]


def test_violations(spark, rows):
    totals = spark.createDataFrame([("a", 89), ("b", 90)], "source string, tokens long")
    targets = spark.createDataFrame([("a", 100), ("b", 100), ("c", 1)], "source string, target long")
    assert [r[1] for r in rows(corpus.shortfalls(totals, targets, ["source"]))] == ["a", "c"]
    assert rows(corpus.out_of_range(totals, 0, 200)) == []
