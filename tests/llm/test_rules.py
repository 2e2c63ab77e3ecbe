"""Measures and verdicts against brute force."""

import random
import re
import time

from factorloom.llm import rules

SCHEMA = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {x for x in windows if windows.count(x) > 1} if len(windows) < 400 else {x for x, n in __import__("collections").Counter(windows).items() if n > 1}
    covered = {k for i, x in enumerate(windows) if x in twice for k in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def corpus(seed=0):
    r = random.Random(seed)
    bits = ["the", "of", "and", "word", "longeré", "#", "a*b", "\n", "\t", "…", "x", "\U0001f600", "- item", "<p>", "\r\n", "\x0b"]
    return [(k, r.choice([" ", "  ", " "]).join(r.choice(bits) for _ in range(r.choice([0, 1, 3, 60, 300])))) for k in range(120)]


def test_measures_by_brute_force(spark):
    rows = [*corpus(), (900, None), (901, ""), (902, "a b c a b c a b c"), (903, "x y " * 20_000)]
    got = {r["doc_id"]: r["quality"] for r in rules.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, text in rows:
        m = got[i]["measures"]
        mine = (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"])
        assert mine == plain(text), (i, text[:80] if text else text)
        n, _, _, _, rep = mine
        assert got[i]["base_failed"] == (n < 50 or 100 * rep > 50 * n)
        assert not (got[i]["base_failed"] and got[i]["kept"])


def test_prose_stays_and_junk_goes(spark):
    r = random.Random(1)
    prose = ". ".join(" ".join(r.choice(["the", "of", "a", "house", "river", "walks", "green", "is", "over", f"name{k}"]) for k in range(9)) for _ in range(12))
    rows = [(1, prose), (2, "too short"), (3, "spam spam spam " * 40), (4, " ".join("$" * 3 for _ in range(80))), (5, prose + "\n" + "\n".join(["same line of words here"] * 300)), (6, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [x["doc_id"] for x in rules.keep_good(df).collect()] == [1]
    broken = {x["doc_id"]: x["quality"]["broken"] for x in rules.judge(df).collect()}
    assert "length" in broken[2] and "repeated words" in broken[3] and "symbols" in broken[4]


def test_one_projection_without_user_functions(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    plan = rules.judge(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and "Arrow" not in plan


def test_empty_table_clashes_and_repeats(spark):
    assert rules.keep_good(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, "a", "q", "r", 1), (1, "a", "q", "r", 1), (None, None, None, None, None)], "doc_id long, text string, quality string, row string, measures int")
    assert rules.judge(df).count() == 3 and rules.keep_good(df).columns == df.columns


def test_a_very_long_text(spark):
    prose = "the house of the river is green and quiet . " * 3
    text = "\n".join(f"{prose} name{k} line{k * 7} part{k * 13} and that is all of it number{k}" for k in range(40_000))
    start = time.perf_counter()
    got = rules.judge(spark.createDataFrame([(1, text)], SCHEMA)).first()["quality"]
    assert got["measures"]["n_words"] == len(WORD.findall(text)) and time.perf_counter() - start < 20
