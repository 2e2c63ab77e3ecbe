"""Phrase and proximity matches against brute force."""

import random
import re
from collections import Counter

import pytest

from factorloom.llm import decontam

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(text, items, window):
    words, hit, ids = terms(text), set(), set()
    for item_id, t in items:
        own = terms(t)
        width = min(window, len(own))
        for k in range(len(own) - width + 1) if own else ():
            for s in range(len(words) - width + 1):
                if words[s : s + width] == own[k : k + width]:
                    hit |= set(range(s, s + width))
                    if item_id is not None:
                        ids.add(str(item_id))
    return len(words), len(hit), sorted(ids)


def judged(spark, rows, items, window):
    docs = spark.createDataFrame(rows, DOCS)
    found = decontam.phrase_matches(docs, decontam.search(docs, spark.createDataFrame(items, ITEMS), window))
    out = found.select("doc_id", "n_words", decontam.hit_positions(found["matches"]).alias("hit"), decontam.item_ids(found["matches"]).alias("ids")).collect()
    return sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], len(r["hit"]), r["ids"]) for r in out))


def corpus(seed, window):
    r = random.Random(seed)
    vocabulary = [f"t{k}" for k in range(12)] + ["É", "Straße", "THE", "the", "x1"]
    items = [(k, r.choice([" ", ", ", "\n"]).join(r.choice(vocabulary) for _ in range(r.choice([1, 2, window - 1, window, window + 1, 3 * window])))) for k in range(14)]
    items += [(3, items[3][1]), (None, items[5][1]), (100, None), (101, "..."), (10, items[4][1]), (9, items[4][1])]
    rows = []
    for k in range(60):
        words = [r.choice(vocabulary) for _ in range(r.choice([0, 1, 5, 60]))]
        if r.random() < 0.6:
            t = (r.choice(items)[1] or "").split()
            at = r.randrange(len(words) + 1)
            cut = t[r.randrange(len(t)) if t and r.random() < 0.3 else 0 :]
            words[at:at] = cut
        rows.append((k, r.choice([" ", "; ", "\t"]).join(words)))
    return rows + [(500, None), (501, ""), (501, items[0][1]), (None, items[2][1]), (7, rows[7][1])], items


@pytest.mark.parametrize("seed,window", [(1, 10), (2, 4), (3, 2)])
def test_by_brute_force(spark, seed, window):
    rows, items = corpus(seed, window)
    want = sorted(((i is None, i or 0, *plain(t, items, window)) for i, t in rows))
    assert judged(spark, rows, items, window) == want
    assert any(x[3] for x in want)


def test_benchmark_side_too_large_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontam.bounded, "__defaults__", (0,))
    rows, items = corpus(4, 5)
    assert judged(spark, rows, items, 5) == sorted(((i is None, i or 0, *plain(t, items, 5)) for i, t in rows))


def test_only_contaminated_rows_go(spark):
    passage = " ".join(f"word{k}" for k in range(14))
    rows = [(1, "clean text", "a"), (2, f"before {passage.upper()}, after", "b"), (3, " ".join(passage.split()[:9]), "c"), (None, passage, "d"), (5, None, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, content string")
    items = spark.createDataFrame([(1, passage), (2, "another item " * 8)], ITEMS)
    out = decontam.drop_contaminated(df, items)
    assert out.columns == df.columns and {r["doc_id"] for r in out.collect()} == {1, 3, 5}


def plain_proximity(rows, items, window, slop):
    counts = Counter(w for _, t in rows for w in terms(t))
    near = set()
    for item_id, text in items:
        own = terms(text)
        for start in range(max(len(own) - window, 0) + 1) if len(own) > 1 else ():
            places = sorted(range(start, min(start + window, len(own))), key=lambda k: (counts[own[k]], k))[:2]
            p, q = sorted(places)
            for i, t in rows:
                words = terms(t)
                for x, w in enumerate(words):
                    lo = max(0, x - (q - p) - slop)
                    if w == own[p] and any(y != x and words[y] == own[q] for y in range(lo, min(len(words), x + (q - p) + slop + 1))):
                        near.add((i, item_id))
    return near


@pytest.mark.parametrize("seed,window,slop", [(5, 10, 5), (6, 4, 0), (7, 3, 1)])
def test_proximity_by_brute_force(spark, seed, window, slop):
    rows, items = corpus(seed, window)
    found = decontam.search(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS), window)
    got = {(r["doc_id"], r["item_id"]) for r in decontam.proximity_matches(found, slop).collect()}
    assert got == plain_proximity(rows, items, window, slop) and got


def test_proximity(spark):
    items = spark.createDataFrame([(1, "alpha common common beta common")], ITEMS)
    rows = [(1, "alpha common x common beta common"), (2, "alpha " + "x " * 40 + "beta"), (3, "common common"), (4, "beta common common alpha")]
    near = {r["doc_id"] for r in decontam.proximity_matches(decontam.search(spark.createDataFrame(rows, DOCS), items), slop=2).collect()}
    assert near == {1, 4}


def test_one_word_is_no_pair_with_itself(spark):
    items = spark.createDataFrame([(1, "same and same")], ITEMS)
    rows = [(1, "same"), (2, "same x same"), (3, "and and and and and")]
    near = {r["doc_id"] for r in decontam.proximity_matches(decontam.search(spark.createDataFrame(rows, DOCS), items), slop=0).collect()}
    assert near == {2}


def test_a_very_long_text(spark):
    passage = " ".join(f"word{k}" for k in range(14))
    rows = [(1, "filler text word1 word2 " * 300_000 + passage), (2, "filler text word1 word2 " * 300_000)]
    docs, items = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(1, passage)], ITEMS)
    got = {r["doc_id"]: (r["n_words"], len(r["matches"])) for r in decontam.phrase_matches(docs, decontam.search(docs, items)).collect()}
    assert got == {1: (1_200_014, 1), 2: (1_200_000, 0)}


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], DOCS), spark.createDataFrame([(1, "a b")], ITEMS)
    nothing = spark.createDataFrame([], DOCS)
    assert decontam.phrase_matches(nothing, decontam.search(nothing, items)).count() == 0
    none = decontam.search(docs, spark.createDataFrame([], ITEMS))
    assert decontam.phrase_matches(docs, none).first()["matches"] == [] and decontam.proximity_matches(none).count() == 0
    assert decontam.drop_contaminated(docs, spark.createDataFrame([], ITEMS)).count() == 1
