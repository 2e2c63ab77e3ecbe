"""Windows, intervals and kept texts against brute force."""

import hashlib
import random

import pytest

from factorloom.llm import substring
from factorloom.llm.queries import op3_substring_dedup

SCHEMA = "doc_id long, text string"


def plain(rows, window):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    owners = {}
    for i, w in words:
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                owners[key] = min(owners.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        if i is not None:
            for k in range(len(w) - window + 1):
                if owners[tuple(w[k : k + window])] < i:
                    gone |= set(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone).decode()
        out.append((i, len(w), len(gone), kept))
    return sorted(out, key=repr)


def corpus(seed):
    r = random.Random(seed)
    passages = [[f"p{k}_{i}" for i in range(r.randrange(4, 40))] for k in range(6)]
    rows = []
    for i in range(80):
        words = []
        for _ in range(r.randrange(0, 6)):
            words += r.choice(passages) if r.random() < 0.5 else [f"{r.randrange(40)}" for _ in range(r.randrange(1, 30))]
        rows.append((r.randrange(70), r.choice([" ", "\n", " \t"]).join(words)))
    return rows + [(200, None), (201, ""), (None, " ".join(passages[0])), (3, "same again " * 20), (3, "same again " * 20)]


@pytest.mark.parametrize("window,per_block", [(13, 1024), (3, 5), (1, 7)])
def test_by_brute_force(spark, window, per_block):
    rows = corpus(window)
    got = substring.dedup_substrings(spark.createDataFrame(rows, SCHEMA).repartition(4), window, per_block).collect()
    mine = sorted(((r["doc_id"], r["n_words"], sum(x["end"] - x["start"] for x in r["removed"]), r["kept_text"]) for r in got), key=repr)
    assert mine == plain(rows, window)
    for r in got:
        ends = [(x["start"], x["end"]) for x in r["removed"]]
        assert all(a < b for a, b in ends) and all(ends[k][1] < ends[k + 1][0] for k in range(len(ends) - 1))


def test_rolling_hash_depends_on_the_window_alone():
    a, b = [b"x", b"y", b"z", b"u", b"v"], [b"q", b"z", b"u", b"v"]
    assert substring.window_hashes(a, 3)[2] == substring.window_hashes(b, 3)[1]
    assert substring.window_hashes(a, 3)[0] != substring.window_hashes([b"z", b"y", b"x"], 3)[0]
    assert len(substring.window_hashes(a, 6)) == 0


def test_planted_passage_is_cut_from_the_later_document(spark, tmp_path):
    passage = " ".join(f"w{i}" for i in range(55))
    rows = [(1, f"first {passage} end"), (2, f"other beginning {passage} tail"), (3, "nothing shared here")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op3_substring_dedup(spark, str(tmp_path)).collect()}
    assert [got[k]["n_removed"] for k in (1, 2, 3)] == [0, 55, 0]
    assert got[2]["kept_sha256"] == hashlib.sha256(b"other beginning tail").hexdigest()


def test_rows_without_an_id_and_a_very_long_text(spark):
    long = " ".join(f"u{k}" for k in range(400_000))
    rows = [(None, "the same text without an id " * 9)] * 300 + [(7, "the same text without an id " * 9), (1, long), (2, long + " tail"), (3, None)]
    got = substring.dedup_substrings(spark.createDataFrame(rows, SCHEMA)).collect()
    gone = {r["doc_id"]: r["n_words"] - len(r["kept_text"].split()) for r in got}
    assert len(got) == len(rows) and gone[None] == 0 and gone[7] == 0 and gone[1] == 0 and gone[2] == 400_000 and gone[3] == 0


def test_tasks_grow_with_the_texts(spark, monkeypatch):
    monkeypatch.setattr(substring, "BYTES_PER_TASK", 500)
    df = spark.createDataFrame(corpus(13), SCHEMA)
    got = substring.dedup_substrings(df, docs_per_block=2)
    assert got.rdd.getNumPartitions() > 20
    mine = sorted(((r["doc_id"], r["n_words"], sum(x["end"] - x["start"] for x in r["removed"]), r["kept_text"]) for r in got.collect()), key=repr)
    assert mine == plain(corpus(13), 13)


def test_empty_table_and_clashing_columns(spark):
    assert substring.dedup_substrings(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = spark.createDataFrame([(1, "a b", 5, "x")], "doc_id long, text string, block long, content string")
    assert substring.dedup_substrings(odd).first()["kept_text"] == "a b"
