"""Groups of near copies against brute force over all pairs, with planted copies on both sides of the bound."""

import random

import pytest

import corpus_pipeline
from factorloom.llm import nearcopies

SCHEMA = "doc_id long, text string"


def plain_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_groups(rows):
    sets, parent = [plain_set(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if (x == y or 9 * len(x & y) >= 4 * (len(x) + len(y))) and root(a) != root(b):
                parent[root(a)] = root(b)
    return [root(k) for k in range(len(rows))]


def corpus(seed, n=50):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(4000)}"
    hot, passage = [word() for _ in range(150)], [word() for _ in range(60)]
    rows = []
    for k in range(n):
        base = [word() for _ in range(r.choice([1, 3, 5, 6, 30, 120, 400]))]
        base += passage if k % 4 == 0 else []
        rows.append(base)
        for _ in range(r.choice([0, 1, 3])):
            copy = list(rows[-1] if r.random() < 0.5 else base)
            for _ in range(round(len(copy) * r.choice([0, 0.005, 0.01, 0.02, 0.025, 0.05]))):
                copy[r.randrange(len(copy))] = word()
            rows.append(copy)
    for _ in range(60):  # one large group of near copies, and copies that miss the bound
        copy = list(hot)
        for _ in range(r.choice([0, 1, 2, 3, 4, 8])):
            copy[r.randrange(len(copy))] = word()
        rows.append(copy[: r.choice([150, 150, 140, 125, 110])])
    texts = [r.choice([" ", "\n", "\t "]).join(w) for w in rows]
    texts = [t.upper() if r.random() < 0.1 else t for t in texts] + ["", None, " \n "]
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_the_stage_keeps_one_of_each_group(spark, seed):
    rows = corpus(seed)
    groups = plain_groups(rows)
    want = {min(i for (i, _), g in zip(rows, groups) if g == h) for h in groups}
    df = spark.createDataFrame(rows, SCHEMA)
    got = corpus_pipeline.near_duplicates(spark, df, "")
    assert got.columns == df.columns
    kept = [r["doc_id"] for r in got.collect()]
    assert len(kept) == len(set(kept)) and set(kept) == want and len(want) < len(rows)


def test_one_row_of_a_group_stays_whatever_its_ids_are(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(None, text), (3, text), (3, text), (3, "quite another text of its own"), (None, "no id and no copy at all"), (None, "no id and no copy at all")]
    got = [(r["doc_id"], r["text"]) for r in nearcopies.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=repr) == sorted([(3, text), (3, rows[3][1]), (None, rows[4][1])], key=repr)
    assert nearcopies.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0


def unlike_texts(n, seed=5):
    """Texts with the same 30 words at a random place, otherwise of their own, and a near copy of every tenth."""
    r = random.Random(seed)
    shared = " ".join(f"menu{i}" for i in range(30))
    rows = []
    for k in range(n):
        words = [f"d{k}x{i}" for i in range(r.choice([20, 40, 60]))]
        at = r.randrange(len(words))
        rows.append(" ".join([*words[:at], shared, *words[at:]]))
        if k % 10 == 0:
            rows.append(rows[-1] + " more")
    r.shuffle(rows)
    return list(enumerate(rows))


def test_hot_lists_are_not_joined_with_themselves(spark, monkeypatch):
    """With so few slots that the order says nothing, common shingles fill the prefixes. They are found and put last: pairs grow with
    the texts and not with their square, and the same documents stay."""
    monkeypatch.setattr(nearcopies, "SLOT_BITS", 3)
    monkeypatch.setattr(nearcopies, "LONGEST", 10)
    met = []
    real = nearcopies.similar
    monkeypatch.setattr(nearcopies, "similar", lambda pairs, rows, docs: (met.append(pairs.count()), real(pairs, rows, docs))[1])
    counts = []
    for n in (200, 400):
        rows = unlike_texts(n)
        groups = plain_groups(rows) if n == 200 else None
        met.clear()
        kept = {r["doc_id"] for r in nearcopies.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert len(kept) == n
        assert groups is None or kept == {min(i for (i, _), g in zip(rows, groups) if g == h) for h in groups}
        counts.append(sum(met))
    assert counts[1] < 3 * counts[0] and counts[1] < 400 * 30


def test_hot_shingles_come_last():
    import numpy as np

    hashes, ranks = np.arange(1, 31, dtype=np.uint64) << np.uint64(50), np.arange(1 << 16, dtype=np.uint64)
    plain = nearcopies.prefix(hashes, ranks)
    assert len(plain) == 30 - 24 + 1 and (np.diff(plain) > 0).all()
    later = nearcopies.prefix(hashes, ranks, np.sort(plain[:3]))
    assert len(later) == 7 and not np.isin(later, plain[:3]).any() and (later[:4] == plain[3:]).all()
    everything = nearcopies.prefix(hashes, ranks, np.sort(nearcopies.prefix(np.repeat(hashes, 5)[:0], ranks)))
    assert (everything == plain).all()


def test_long_texts_and_clashing_columns(spark):
    long = " ".join(f"w{i % 5000} v{i}" for i in range(200_000))
    names = ("row", "content", "node", "slot", "text_", "n", "counts", "token", "component", "best", "name_id", "name_content", "times", "none")
    rows = [(1, long, "a"), (2, long + " end", "b"), (3, "short", "c"), (4, None, "d"), (5, "", "e")]
    df = spark.createDataFrame([(*r[:2], *[r[2]] * len(names)) for r in rows], f"{SCHEMA}, {', '.join(f'{x} string' for x in names)}")
    got = nearcopies.keep_one(df).collect()
    assert sorted((r["doc_id"], r["row"], r["component"]) for r in got) == [(1, "a", "a"), (3, "c", "c"), (4, "d", "d")]
    assert all(list(r.asDict()) == df.columns for r in got)


def test_outlines_only_rule_out_what_is_not_similar():
    import numpy as np

    r = np.random.default_rng(3)
    pruned = 0
    for _ in range(300):
        n = int(r.integers(1, 400))
        a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[: int(len(a) * r.random() ** 0.3)], r.integers(0, 1 << 63, int(n * r.random() * 0.3), dtype=np.uint64)]))
        x, y = (np.frombuffer(nearcopies.outline(s), "<u2").astype(int) for s in (a, b))
        may_be = 9 * np.minimum(x, y).sum() >= 4 * (x.sum() + y.sum())
        pruned += not may_be
        assert may_be or not 9 * len(np.intersect1d(a, b)) >= 4 * (len(a) + len(b))
    assert pruned
    assert nearcopies.outline(np.zeros(1 << 16, np.uint64)) == b""


def test_fingerprints_give_candidates_and_the_exact_check_judges_them(spark):
    from factorloom.llm.nearcopies import shingle_set, simhash_pairs, similar, tagged
    from factorloom.llm.simhash import fingerprint_of

    words = [f"w{k}" for k in range(400)]
    print_of = lambda w: fingerprint_of(shingle_set(" ".join(w)))
    changed = (words[:k] + ["x"] + words[k + 1 :] for k in range(400))
    near = next(w for w in changed if (print_of(w) ^ print_of(words)).bit_count() <= 2)
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(reversed(words))), (4, "")], "doc_id long, text string")
    rows = tagged(docs)
    prints = {r["doc_id"]: (r["node"], r["print"] & (1 << 64) - 1) for r in rows.collect()}
    pairs = {(r["a"], r["b"]) for r in simhash_pairs(rows).collect()}
    one, two = prints[1][0], prints[2][0]
    assert pairs == {(max(one, two), min(one, two))} and prints[4][1] == 0
    # Whole sets judge every candidate.
    forced = spark.createDataFrame([(one, two), (one, prints[3][0])], "a long, b long")
    assert [(r["a"], r["b"]) for r in similar(forced, rows, docs).collect()] == [(one, two)]
