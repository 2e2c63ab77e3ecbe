"""Tokens, pieces, sequences and bounds, with an exact round trip."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from factorloom.llm import packing  # noqa: E402

SCHEMA = "doc_id long, text string"
TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def corpus(seed=0, n=80):
    r = random.Random(seed)
    bits = ["the", "straße", "don't", "  two", "\n\n", "x" * 30, "\U0001f600", "1234567", "a.b,c", "\t", "<|endoftext|>", " ", "é", " ", "中文"]
    return [(k, r.choice([" ", "", "\n"]).join(r.choice(bits) for _ in range(r.choice([0, 1, 4, 50, 900])))) for k in range(n)]


def test_tokens_equal_the_tokenizer():
    encoder = packing.Encoder(*packing.vocabulary_paths())
    for _, text in corpus(1, 150):
        assert np.frombuffer(encoder(text), "<u4").tolist() == ids_of(text)[:-1], repr(text[:60])


def test_round_trip(spark):
    rows = corpus(2) + [(900, None), (901, ""), (902, "long text of words " * 2000), (903, "twice"), (903, "twice"), (None, "no id")]
    got = packing.pack_documents(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(ids_of(t))
    by_doc, by_sequence = {}, {}
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] <= packing.CAPACITY and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        by_doc.setdefault(r["doc_id"], []).append((r["piece"], r["start"], ids))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, wanted in texts.items():
        if len(wanted) == 1:
            pieces = sorted(by_doc[i])
            assert [x for _, _, ids in pieces for x in ids] == wanted[0]
            assert [p for p, _, _ in pieces] == list(range(len(pieces)))
            assert [s for _, s, _ in pieces] == [sum(len(x) for _, _, x in pieces[:k]) for k in range(len(pieces))]
            assert len(pieces) == -(-len(wanted[0]) // 1024) and all(len(x) == 1024 for _, _, x in pieces[1:])
    assert len(by_doc[903]) == 2 and len(by_doc[None]) == 1
    total = 0
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
        total += at
    lengths = [r["length"] for r in got]
    assert sum(lengths) == total and len(by_sequence) <= packing.lower_bound(np.array(lengths), 1024) + 1


def fewest(lengths, capacity):
    best = len(lengths)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for room in set(bins):
            if room >= lengths[k]:
                rest = list(bins)
                rest.remove(room)
                place(k + 1, [*rest, room - lengths[k]])
        place(k + 1, [*bins, capacity - lengths[k]])

    place(0, [])
    return best


def test_bounds_never_exceed_the_optimum():
    r = random.Random(3)
    for _ in range(60):
        lengths = sorted((r.randrange(1, 31) for _ in range(r.randrange(1, 9))), reverse=True)
        bound = packing.lower_bound(np.array(lengths), 30)
        assert -(-sum(lengths) // 30) <= bound <= fewest(lengths, 30)
    assert packing.lower_bound(np.array([16] * 5), 30) == 5
    assert packing.lower_bound(np.array([11] * 6), 30) >= 3


def test_best_fit_takes_the_tightest_bin():
    lengths = np.array([7, 6, 4, 3])
    bins = packing.best_fit(lengths, 10)
    assert bins[0] == bins[3] and bins[1] == bins[2]


def test_uncertified_partitions_exchange_their_rest(spark):
    r = random.Random(4)
    rows = [(str(k), k, 0, k, r.choice([340, 350, 500, 520, 700, 30])) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id string, content long, piece int, key long, length long")
    many = packing.pack(df, per_task=100).select("sequence_id").distinct().count()
    alone = packing.pack(df, per_task=100, rounds=0).select("sequence_id").distinct().count()
    bound = packing.lower_bound(np.array([x[4] for x in rows]), 1024)
    assert bound <= many <= alone
    placed = packing.pack(df, per_task=100).join(df, "key").groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert placed.where("n != end or n > 1024").isEmpty()


def test_certificates_hold(spark):
    rows = [(k, "word " * (k * 37 % 900 + 1)) for k in range(300)] + [(7, "twice the same " * 100)] * 200
    packed = packing.pack_documents(spark.createDataFrame(rows, SCHEMA).repartition(4))
    found = packing.certificates(packed).collect()
    assert sum(r["sequences"] for r in found) == packed.select("sequence_id").distinct().count()
    assert all(r["part_bound"] <= r["part_bins"] and r["sequences"] <= r["part_bins"] for r in found)
    lengths = np.array([r["length"] for r in packed.collect()])
    if len(found) == 1:
        assert found[0]["part_bound"] == packing.lower_bound(lengths, 1024)


def test_equal_rows_are_dealt_to_all_partitions(spark):
    df = spark.createDataFrame([("5", 1, 0, k, 300) for k in range(2000)], "doc_id string, content long, piece int, key long, length long")
    sizes = packing._packed(df, 20, 0, 1024).groupBy("part").count().collect()
    assert len(sizes) == 20 and max(r["count"] for r in sizes) < 200


def test_a_very_long_text(spark):
    row = packing.pack_documents(spark.createDataFrame([(1, "word and " * 600_000)], SCHEMA)).agg(F.sum("length").alias("n"), F.max("length").alias("most")).first()
    assert row["n"] == 1_200_002 and row["most"] == 1024


def test_empty_table_and_clashing_columns(spark):
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = spark.createDataFrame([(1, "a b", 5, 7, "k")], "doc_id long, text string, piece int, length long, key string")
    row = packing.pack_documents(odd).first()
    assert (row["piece"], row["length"], row["offset"]) == (0, 3, 0)
