"""The numbered queries: each applies one operator to a whole table and derives the agreed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, fillmiddle, langid, mixing, packing, quality, rules, secrets, sharding, simhash, substring, urlfilter, whitening
from .common import stored, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest, slot_map = sharding.plan(table(spark, sf_dir, "documents"))
    return sharding.places(digest, slot_map).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("place").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.dedup_substrings(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return cut.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans, as they follow each other in use: one by the base rules, and, when rules have been added, one that looks up
    the first one's ledger and scans only pairs of blob and rule version that are new."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    _, ledger = secrets.scan(docs, rules=secrets.BASE_RULES)
    paths, _ = secrets.scan(docs, ledger)
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    kinds = [r.kind for r in secrets.BASE_RULES]
    base = secrets.span_text(F.filter("findings", lambda x: x["kind"].isin(kinds)))
    return paths.select("doc_id", *map(count, kinds), F.sha2(base, 256).alias("base_sha256"), secrets.span_text(F.col("findings")).alias("spans"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``n_near`` counts the items with a proximity match, from the same index."""
    docs = table(spark, sf_dir, "documents")
    found = decontam.search(docs, table(spark, sf_dir, "benchmark"))
    near = decontam.proximity_matches(found).groupBy(F.col("doc_id").alias("near_id"), F.col("content").alias("near_content")).agg(F.count_distinct("item_id").alias("n_near"))
    judged = decontam.phrase_matches(docs, found).join(near, F.col("doc_id").eqNullSafe(F.col("near_id")) & (F.col("content") == F.col("near_content")), "left")
    hit, items = F.size(decontam.hit_positions(F.col("matches"))).cast("long"), decontam.item_ids(F.col("matches"))
    return judged.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), with_ids=False)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *[F.col(f"quality.measures.{c}").alias(c) for c in counts], "quality.base_failed", "quality.kept")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    languages, likelihood = langid.train(table(spark, sf_dir, "documents"))
    return langid.identify(table(spark, sf_dir, "pages"), languages, likelihood)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fillmiddle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    again = fillmiddle.restored(F.col("fim.output"), F.col("fim.form"))
    return cut.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", F.sha2("fim.output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whole_rows(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    model = whitening.fit(rows)
    found = stored(whitening.whiten(rows, model).select("vec_id", "deviation", "whitened"), "whitened")
    error = whitening.identity_error(found, len(model.explained))
    each = found.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    explained = F.get(F.array(*map(F.lit, model.explained)) if model.explained else F.array(F.lit(0.0)), F.col("k"))
    return each.select(
        "vec_id",
        (F.col("k") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        explained.alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``copies`` is how often the mix takes the document."""
    taken = mixing.plan(table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash,
        op2_sharding,
        op3_substring_dedup,
        op4_secrets,
        op5_quality,
        op6_decontamination,
        op7_url_filter,
        op8_packing,
        op9_quality_rules,
        op10_language,
        op11_fill_in_middle,
        op12_whitening,
        op13_mixing,
    )
}
