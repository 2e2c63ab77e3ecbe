"""Mixing: targets by plain rounds of sharing, draws by brute force, hot sources and equal rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from factorloom.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes):
    """Rounds of sharing what is left by weight; a source over twice its size stops there."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, full = dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values()), set()
    while left > 1e-9 and len(full) < len(order):
        total = sum(weight[s] for s in order if s not in full)
        for s in order:
            if s not in full:
                target[s] += left * weight[s] / total
        left = 0.0
        for s in order:
            if target[s] > 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                full.add(s)
    return target


def plain_plan(rows):
    """Counter of (doc_id, size, source, copies)."""
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += n_words(text)
    target = plain_targets(sizes)
    seen, drawn = Counter(), []
    for doc_id, text, source in rows:
        content = hashlib.md5((text or "").encode()).hexdigest()
        seen[doc_id, source, content] += 1
        h = hashlib.md5(f"{'' if doc_id is None else doc_id}:{seen[doc_id, source, content]}:{content}".encode()).hexdigest()
        drawn.append((doc_id, n_words(text), source, int(h[:8], 16), int(h[8:16], 16)))
    rate = {s: target[s] / sizes[s] if sizes[s] else 0.0 for s in sizes}
    copies = lambda r, seed: int(rate[r[2]]) + ((r[3] + seed * r[4]) % 2**32 / 2**32 < rate[r[2]] - int(rate[r[2]]))
    best = {s: min(range(16), key=lambda k: (round(abs(sum(r[1] * copies(r, k) for r in drawn if r[2] == s) - target[s]), 6), k)) for s in sizes}
    return Counter((r[0], r[1], r[2], copies(r, best[r[2]])) for r in drawn), target


def odd_rows(seed, n=500):
    r = random.Random(seed)
    sources = ["hot"] * 8 + ["b", "é", "漢", "😀", "", None, "Z", "a", "empty"]
    rows = []
    for i in range(n):
        source = r.choice(sources)
        text = r.choice([None, "", "  "]) if source == "empty" else " ".join(r.choice(["x", "yy", "z\tq"]) for _ in range(r.choice([0, 1, 5, 40])))
        rows.append((r.choice([None, i, i]), text, source))
    return rows + rows[:40] + [(None, "same words", "hot")] * 100


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    rows = odd_rows(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    want, target = plain_plan(rows)
    got = mixing.plan(df).collect()
    assert Counter((g["doc_id"], g["size"], g["source"], g["copies"]) for g in got) == want
    for g in got:
        assert g["target"] == pytest.approx(target[g["source"]], rel=1e-9, abs=1e-9)
        assert g["copies"] <= 2


def test_mix_emits_the_plan(spark):
    rows = odd_rows(4, 300)
    df = spark.createDataFrame(rows, SCHEMA)
    want = Counter()
    texts = {}
    for g in mixing.plan(df).collect():
        want[g["doc_id"], g["source"], g["content"]] += g["copies"]
    for _, text, _ in rows:
        texts[hashlib.md5((text or "").encode()).hexdigest()] = text or ""
    got = Counter((r["doc_id"], r["source"], hashlib.md5((r["text"] or "").encode()).hexdigest()) for r in mixing.mix(df).collect())
    assert got == +want


def test_sources_come_near_their_targets(spark, sf_dir):
    got = mixing.plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    sums = got.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target"), F.max("size").alias("most")).collect()
    assert all(abs(s["taken"] - s["target"]) <= 0.5 * s["most"] + 1 for s in sums)


def test_equal_rows_draw_apart(spark, monkeypatch):
    """A group of equals takes its share, though one draw for all of them would be all or nothing."""
    monkeypatch.setattr(mixing, "CHUNK", 64)
    df = spark.range(5000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("five words are in here").alias("text"), F.lit("s").alias("source"))
    more = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("three more words").alias("text"), F.lit("t").alias("source"))
    got = mixing.plan(df.unionByName(more)).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target"), F.count("*").alias("n")).collect()
    assert all(g["n"] == 5000 and abs(g["taken"] - g["target"]) < 0.02 * g["target"] for g in got)
    assert mixing.mix(df.unionByName(more)).where("source = 's'").distinct().count() == 1


def test_reruns_and_partitions(spark):
    df = spark.createDataFrame(odd_rows(5), SCHEMA)
    one, two = (sorted(map(repr, mixing.plan(x).collect())) for x in (df.coalesce(1), df.repartition(13)))
    assert one == two


def test_empty_and_wordless_tables(spark):
    assert mixing.plan(spark.createDataFrame([], SCHEMA)).isEmpty() and mixing.mix(spark.createDataFrame([], SCHEMA)).isEmpty()
    got = mixing.plan(spark.createDataFrame([(1, None, None), (2, "", "a")], SCHEMA)).collect()
    assert [(g["size"], g["target"], g["copies"]) for g in got] == [(0, 0.0, 0)] * 2


def test_a_very_long_text_and_clashing_columns(spark):
    names = ("row", "content", "size", "times", "copies", "equals", "rate", "target", "number", "digest", "name", "seed", "name_doc_id")
    rows = [(1, "long " * 1_000_000, "a"), (2, "short text", "b")]
    df = spark.createDataFrame([(*r, *[f"own {x}" for x in names]) for r in rows], f"{SCHEMA}, {', '.join(f'{x} string' for x in names)}")
    assert {g["doc_id"]: g["size"] for g in mixing.plan(df).collect()} == {1: 1_000_000, 2: 2}
    out = mixing.mix(df).collect()
    assert out and all(o[x] == f"own {x}" for o in out for x in names)
