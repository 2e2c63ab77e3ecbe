"""Language identification by Bayesian evidence fusion.

Four pieces of evidence for each page are multiplied: the likelihood of its visible text under a byte-trigram model of each
language, the declared ``lang`` of its markup, the suffix of its address, and a prior for its host. The prior comes
from the pages themselves: the soft language counts of all pages are added up by host, by site (the last two labels of
the host) and over everything, and each level is smoothed by the next. How far declarations and suffixes can be trusted
is estimated the same way, by grouped sums over all pages. A page's own counts are taken out of every sum that is used
for it, so its text is evidence once.

The trigram model is fitted on a bounded sample of labelled texts, at most ``MAX_ROWS`` documents of each language in the
order of a hash of the id; its counts are added up in Spark. More than ``MAX_LANGUAGES`` different labels are refused, as
the model would be no small table. All pages are scored from their whole texts, in time linear in their length.

Nulls: a null url has an empty host and suffix; a null html is an empty text and declares nothing; missing evidence
counts for nothing. Without training texts the result is empty but for the keys, with a null language. Repeated rows count
once for each row and get equal answers. Ties go to the language that comes first. Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_or_empty
from .urlfilter import host_of

MAX_ROWS = 1_000
MAX_LANGUAGES = 500
SLOTS = 1 << 15
#: Text evidence counts like at most this many independent trigrams.
SATURATION = 60.0
HOST_STRENGTH, SITE_STRENGTH, TABLE_STRENGTH = 5.0, 20.0, 10.0

OPENING = re.compile(r"(?i)<(?:(script|style)\b|!--)?")
CLOSING = {x: re.compile(rf"(?i)</{x}\s*>") for x in ("script", "style")}
HTML_TAG = re.compile(r"(?i)<html\b")
LANG = re.compile(r"(?i)\blang\s*=\s*[\"']?([a-z]{2,3})")


def visible_text(html: str) -> str:
    """The text outside of tags, comments, scripts and styles, entities decoded. What is opened and never closed is a tag
    if a ``>`` follows, else text. Every search starts where the last one ended or is known to find nothing."""
    out, at = [], 0
    closed = {"script": True, "style": True, "!--": True}
    while True:
        lt = html.find("<", at)
        if lt < 0:
            break
        m, end = OPENING.match(html, lt), -1
        name = (m[1] or "").lower() or ("!--" if m.end() - lt == 4 else "")
        if name and closed[name]:
            if name == "!--":
                end = html.find("-->", m.end())
                end = end + 3 if end >= 0 else -1
            else:
                found = CLOSING[name].search(html, m.end())
                end = found.end() if found else -1
            closed[name] = end >= 0
        if end < 0:
            end = html.find(">", lt + 1) + 1
            if not end:
                break
        out += (html[at:lt], " ")
        at = end
    return entities.unescape("".join([*out, html[at:]]))


def declared_language(html: str) -> str:
    """The first ``lang`` of an opening ``html`` tag, in lower case; empty without one."""
    at = 0
    while tag := HTML_TAG.search(html, at):
        at = html.find(">", tag.end())
        at = at if at >= 0 else len(html)
        if found := LANG.search(html, tag.end(), at):
            return found[1].lower()
    return ""


def trigram_slots(text: str) -> np.ndarray:
    """Hash slots of the byte trigrams of a text in lower case, runs of other characters than letters as one space."""
    letters = re.sub(r"[\W\d_]+", " ", text.lower())
    b = np.frombuffer(f" {letters.strip()} ".encode(), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.int64)
    mixed = b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ b[2:] * np.uint32(0xC2B2AE3D)
    return ((mixed ^ (mixed >> np.uint32(15))) % np.uint32(SLOTS)).astype(np.int64)


def train(docs: DataFrame, max_rows: int = MAX_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, log-likelihoods by slot and language). Only the bounded table of counts reaches the driver."""
    usable = docs.where("lang is not null and text is not null").select("doc_id", "lang", F.xxhash64("doc_id").alias("draw"))
    # Draws are uniform, so a bound from the language's count leaves about twice the wanted rows for the exact rank; no
    # language gathers in one task before that.
    # The counts are a table, whose true size decides how it is joined: by broadcast for any real number of languages.
    counts = stored(usable.groupBy("lang").agg(F.count("*").alias("n")), "langid-counts")
    if counts.count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    share = (F.col("draw").cast("double") / 2.0**64 + 0.5) * F.col("n")
    few = usable.join(counts, "lang").where(share < 2 * max_rows + 50)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id"))
    chosen = few.withColumn("r", rank).where(F.col("r") <= max_rows)
    chosen = chosen.select(F.col("doc_id").alias("chosen_id"), F.col("lang").alias("chosen_lang")).distinct()
    # At most max_rows rows for each language; a table, so that its true size decides how it is joined.
    chosen = stored(chosen, "langid-chosen")
    sample = docs.join(chosen, (F.col("doc_id") == F.col("chosen_id")) & (F.col("lang") == F.col("chosen_lang"))).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                slots = np.concatenate([trigram_slots(t) for t in texts])
                found, n = np.unique(slots, return_counts=True)
                yield pd.DataFrame({"lang": lang, "slot": found, "n": n})

    counts = sample.mapInPandas(count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique().tolist())
    table = np.full((SLOTS, len(languages)), 0.5)
    for k, lang in enumerate(languages):
        own = counts[counts["lang"] == lang]
        table[own["slot"].to_numpy(np.int64), k] += own["n"].to_numpy(float)
    return languages, np.log(table / table.sum(0)) if languages else table


def text_evidence(pages: DataFrame, languages: list[str], likelihood: np.ndarray) -> DataFrame:
    """(page_id, host, site, suffix, declared, text_log): the log-likelihood of the text for each language."""
    small = likelihood.astype(np.float32)

    def of_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            logs = []
            for page in b["html"]:
                slots = trigram_slots(visible_text(page))
                n = len(slots)
                # A block of slots at a time, as a long page would give a table of slots by languages.
                total = np.zeros(len(languages))
                for lo in range(0, n, 65_536):
                    total += small[slots[lo : lo + 65_536]].sum(0, dtype=np.float64)
                logs.append((total - total.max()) * (min(1.0, SATURATION / n) if n else 0.0))
            yield b.drop(columns="html").assign(declared=[declared_language(x) for x in b["html"]], text_log=logs)

    host = host_of(F.col("url"))
    labels = F.split(F.regexp_replace(host, ":\\d*$", ""), "\\.")
    rows = pages.select(
        F.col("page_id").cast("string").alias("page_id"),
        host.alias("host"),
        F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".").alias("site"),
        F.get(labels, F.size(labels) - 1).alias("suffix"),
        text_or_empty("html").alias("html"),
    )
    schema = "page_id string, host string, site string, suffix string, declared string, text_log array<double>"
    return rows.mapInPandas(of_batches, schema).withColumn("page_id", F.col("page_id").cast("long"))


def _normal(logs: Column) -> Column:
    """Logs to probabilities."""
    top = F.array_max(logs)
    raw = F.transform(logs, lambda v: F.exp(v - top))
    return F.transform(raw, lambda v: v / F.aggregate(raw, F.lit(0.0), lambda a, x: a + x))


def _sums(rows: DataFrame, keys: list[str], k: int, name: str) -> DataFrame:
    """Soft counts of each language by ``keys``, as an array ``name``."""
    return rows.groupBy(*keys).agg(F.array(*[F.coalesce(F.sum(F.get("soft", F.lit(i))), F.lit(0.0)) for i in range(k)]).alias(name))


def _others(counts: str) -> Column:
    """Counts without the row's own."""
    return F.zip_with(F.col(counts), F.col("soft"), lambda n, own: F.greatest(n - own, F.lit(0.0)))


def _share(counts: Column, prior: Column, strength: float) -> Column:
    """Counts smoothed by a prior that weighs ``strength`` pages."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(counts, prior, lambda n, p: (n + p * strength) / (total + strength))


def identify(pages: DataFrame, languages: list[str], likelihood: np.ndarray) -> DataFrame:
    """(page_id, host, declared, text_lang, lang, confidence) for every page."""
    if not languages:
        nothing = F.lit(None).cast("string")
        return pages.select("page_id", host_of(F.col("url")).alias("host"), nothing.alias("declared"), nothing.alias("text_lang"), nothing.alias("lang"), F.lit(None).cast("double").alias("confidence"))
    k = len(languages)
    names = F.array(*[F.lit(x) for x in languages])
    rows = stored(text_evidence(pages, languages, likelihood), "langid-evidence").withColumn("soft", _normal(F.col("text_log")))
    flat = F.array(*[F.lit(1.0 / k)] * k)
    # Tables, so that their true sizes decide the joins, and so that a host of a third of all pages can be split.
    joined = rows
    for key in ("host", "site", "declared", "suffix"):
        sums = _sums(rows if key in ("host", "site") else rows.where(F.col(key) != ""), [key], k, f"{key}_n")
        joined = joined.join(stored(sums, f"langid-{key}"), key, "left")
    # One row for the whole corpus.
    joined = joined.crossJoin(F.broadcast(stored(_sums(rows, [], k, "all_n"), "langid-all")))

    joined = joined.withColumn("all_share", _share(_others("all_n"), flat, 1.0))
    joined = joined.withColumn("site_share", _share(_others("site_n"), F.col("all_share"), SITE_STRENGTH))
    joined = joined.withColumn("host_share", _share(_others("host_n"), F.col("site_share"), HOST_STRENGTH))
    zero = F.array(*[F.lit(0.0)] * k)

    def lift(name: str) -> Column:
        """log P(value | language) / P(value), as P(language | value) / P(language): what the value adds to the prior."""
        share = F.zip_with(_share(_others(f"{name}_n"), F.col("all_share"), TABLE_STRENGTH), "all_share", lambda a, b: F.log(a / b))
        return F.coalesce(share, zero)

    parts = F.array(F.col("text_log"), F.transform("host_share", lambda x: F.log(x)), lift("declared"), lift("suffix"))
    fused = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.aggregate(parts, F.lit(0.0), lambda a, p: a + F.get(p, i)))
    best = lambda p: F.get(names, (F.array_position(p, F.array_max(p)) - 1).cast("int"))
    return (
        joined.withColumn("posterior", _normal(fused))
        .select("page_id", "host", F.nullif("declared", F.lit("")).alias("declared"), best(F.col("text_log")).alias("text_lang"), best(F.col("posterior")).alias("lang"), F.array_max("posterior").alias("confidence"))
    )
