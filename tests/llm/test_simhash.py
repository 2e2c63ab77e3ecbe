"""Fingerprints and components against brute force."""

import random

import numpy as np
import pytest
import xxhash

from factorloom.llm import simhash

SCHEMA = "doc_id long, text string"


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows, radius=2):
    """The smallest known id that each row reaches, by position; rows without an id carry links too."""
    fps, parent = [plain_fingerprint(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, fa in enumerate(fps):
        for b, fb in enumerate(fps[:a]):
            if (fa ^ fb).bit_count() <= radius:
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        g = root(k)
        least[g] = min((x for x in (least.get(g), i) if x is not None), default=None)
    return [least[root(k)] for k in range(len(rows))]


def corpus(seed=0, n=120):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["Ärger", "ÀB", "x y"]
    rows = []
    for k in range(n):
        words = [r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 40, 200]))]
        rows.append((k * 3, r.choice([" ", "\n", "\t "]).join(words)))
        if r.random() < 0.5:
            w = list(words)
            w[r.randrange(len(w))] = "changed"
            rows.append((1000 + k, " ".join(w).upper() if r.random() < 0.3 else " ".join(w)))
        if r.random() < 0.2:
            rows.append((2000 + k, rows[-1][1]))
    return rows + [(5001, ""), (5002, None), (5003, " \n ")]


def test_fingerprint_by_definition():
    for _, text in corpus():
        assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("max_tree", [2048, 3])
def test_components_by_brute_force(spark, max_tree):
    rows = corpus(1)
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), max_tree=max_tree).collect()
    want = plain_components(rows)
    assert answers(got) == sorted(zip((i for i, _ in rows), want), key=repr)
    assert len(set(want)) < len(want)


def answers(got):
    return sorted(((r["doc_id"], r["component_id"]) for r in got), key=repr)


def bridge():
    """Three texts of which the middle one is within 2 bits of both others, which are further apart."""
    r = random.Random(11)
    while True:
        words = [f"w{r.randrange(500)}" for _ in range(250)]
        texts = [" ".join(words)]
        for _ in range(2):
            words = list(words)
            words[r.randrange(len(words))] = "other"
            texts.append(" ".join(words))
        a, n, b = map(plain_fingerprint, texts)
        if 0 < (a ^ n).bit_count() <= 2 and 0 < (n ^ b).bit_count() <= 2 < (a ^ b).bit_count():
            return texts


def test_rows_without_an_id_carry_links(spark):
    a, n, b = bridge()
    rows = [(1, a), (None, n), (2, b), (None, "alone without an id"), (7, "quite alone")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert answers(got) == sorted([(1, 1), (None, 1), (2, 1), (None, None), (7, 7)], key=repr)


def test_one_id_with_two_texts(spark):
    a, n, b = bridge()
    rows = [(5, a), (5, "something else"), (9, n), (9, "something else"), (3, b), (3, b), (None, None)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert answers(got) == sorted(zip((i for i, _ in rows), plain_components(rows)), key=repr)


def test_a_very_long_text(spark):
    rows = [(1, "word and other " * 400_000), (2, "word and other " * 400_001)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert answers(got) == [(1, 1), (2, 1)]


def test_chains_reach_their_smallest_member(spark):
    """Fingerprints in a chain of single bits, whose ends are far apart."""
    nodes = [(k, simhash._signed((1 << k) - 1)) for k in range(1, 41)]
    df = spark.createDataFrame(nodes, "rep long, fp long")
    tied = simhash.components(simhash.links(simhash.shards(df)))
    assert {r["node"]: r["component"] for r in tied.collect()} == {k: 1 for k in range(2, 41)}


@pytest.mark.parametrize("max_tree,rounds", [(2048, 4), (2, 4)])
def test_no_link_is_lost_in_sharding(spark, max_tree, rounds):
    rng = np.random.RandomState(5)
    base = [int(x) for x in rng.randint(0, 1 << 62, 40)]
    fps = set(base)
    for b in base:
        for _ in range(4):
            fps.add(b ^ (1 << int(rng.randint(64))) ^ (1 << int(rng.randint(64))))
    fps = sorted(fps)
    df = spark.createDataFrame([(k, simhash._signed(x)) for k, x in enumerate(fps)], "rep long, fp long")
    tied = {r["node"]: r["component"] for r in simhash.components(simhash.links(simhash.shards(df, max_tree, rounds))).collect()}
    parent = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 2 and parent[j] > parent[i]:
                    parent[j], changed = parent[i], True
    assert {k: tied.get(k, k) for k in range(len(fps))} == dict(enumerate(parent))


def test_bk_trees_follow_only_edges_within_the_radius():
    fps = np.array([0, 1, 3, 7, 1 << 40, 255], np.uint64)
    forest = simhash.BkForest(np.zeros(6, np.int64), fps)
    found = {(int(a), int(b)) for x, y in forest.search(np.arange(6), 2) for a, b in zip(x, y)}
    assert found == {(a, b) for a in range(6) for b in range(6) if (int(fps[a]) ^ int(fps[b])).bit_count() <= 2}
    # A child hangs at its distance from its parent.
    for edge, child in zip(forest.edge, forest.end):
        assert (int(fps[edge // 65]) ^ int(fps[child])).bit_count() == edge % 65


def test_nulls_empty_tables_and_clashing_columns(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    only_null = spark.createDataFrame([(None, "a b c")], SCHEMA)
    assert simhash.near_duplicates(only_null).first()["component_id"] is None
    odd = spark.createDataFrame([(1, "a b c", 1, "x", 2), (2, "a b c", None, None, None)], "doc_id long, text string, fp long, component string, rep long")
    assert {r["component_id"] for r in simhash.near_duplicates(odd).collect()} == {1}
