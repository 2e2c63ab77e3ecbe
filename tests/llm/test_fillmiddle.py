"""Fill-in-the-middle against plain string code, and rows out of the ordinary."""

import hashlib
import random
import re

import pytest

from factorloom.llm import fillmiddle

SCHEMA = "doc_id long, text string"


def plain_cut(doc_id, text, seed=1):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check(spark, rows, seed=1):
    df = spark.createDataFrame(rows, SCHEMA)
    cut = fillmiddle.fill_in_middle(df, seed)
    cut = cut.withColumn("again", fillmiddle.restored(cut["fim.output"], cut["fim.form"]))
    got = sorted((repr(r["doc_id"]), repr(r["text"]), tuple(r["fim"]), r["again"]) for r in cut.collect())
    assert got == sorted((repr(i), repr(t), plain_cut(i, t, seed), t or "") for i, t in rows)
    return got


@pytest.mark.parametrize("seed", [1, 7])
def test_random_texts(spark, seed):
    r = random.Random(seed)
    alphabet = ["a", "Z", "word", " ", "\n", "\t", "9", "é", "漢", "😀", "<", "P", "S>", "M>", "<S", ">", "\\", "$", "\x00"]
    rows = [(i, "".join(r.choice(alphabet) for _ in range(r.choice([0, 1, 2, 31, 32, 33, 64, 65, 300])))) for i in range(400)]
    forms = {g[2][1] for g in check(spark, rows, seed)}
    assert forms == {"plain", "psm", "spm"}


def test_odd_rows(spark):
    rows = [(None, None), (None, ""), (None, "some text here"), (None, "other text"), (1, None), (2, ""), (3, "a <P> b"), (4, "<M>"), (5, "x"), (6, "twice over"), (6, "twice over"), (6, "not the same"), (-7, "..."), (8, "A" * 1000)]
    check(spark, rows)


def test_a_very_long_text(spark):
    check(spark, [(i, "lorem ipsum, dolor sit. " * 60_000) for i in range(5)] + [(9, "b" * 2_000_000), (10, "🎈" * 300_000)])


def test_many_equal_rows(spark):
    df = spark.range(20_000).selectExpr("cast(null as long) as doc_id", "'one text, for all of them' as text")
    cut = fillmiddle.fill_in_middle(df)
    assert cut.groupBy("fim").count().collect()[0]["count"] == 20_000


def test_empty_table_and_clashing_columns(spark):
    assert fillmiddle.fill_in_middle(spark.createDataFrame([], SCHEMA)).isEmpty()
    names = ("fim", "row", "body", "content", "id_key", "parts", "n", "form", "first", "second", "runs", "fim_n", "fim_form")
    df = spark.createDataFrame([(5, "text of some words", *[f"own {x}" for x in names])], f"{SCHEMA}, {', '.join(f'{x} string' for x in names)}")
    row = fillmiddle.fill_in_middle(df).first()
    assert tuple(row["fim"]) == plain_cut(5, "text of some words")
    assert all(row[x] == f"own {x}" for x in names if x != "fim") and row["text"] == "text of some words"


def test_text_is_shuffled_once(spark, sf_dir):
    """What is dealt by the key is the row and the key, and stored requests; no text beside it, and nothing goes through Python."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    plan = fillmiddle.fill_in_middle(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "PythonUDF" not in plan and plan.count("text#") and "NestedLoop" not in plan
    below = plan[plan.index("Project [struct(") :].splitlines()[0]
    assert "AS body" not in below
