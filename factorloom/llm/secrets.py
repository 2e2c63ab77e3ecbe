"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of every text is addressed by the SHA-256 of its bytes. The ledger holds one row for each blob and rule
version that has been scanned, with what was found. A scan takes the blobs of its input, leaves out the pairs of blob
and rule version that the ledger has, scans each remaining blob once, however many paths and versions hold it, and
joins the findings of the whole ledger back to all paths. A blob that no rule's probe fits is entered in the ledger as
clean by its address alone: its text is not shuffled.

Positions come from Spark's own functions: the pieces between matches (``split``) and the matches
(``regexp_extract_all``) alternate, so their lengths add up to code point offsets. Sums and masks are made block by block,
so a text costs time in proportion to its length and its findings.

Nulls: a null text is scanned as an empty one. Empty texts have no findings. Repeated rows and equal texts are one blob,
scanned once; each row gets the findings. Empty tables give empty tables. Other columns are carried along by ``scan``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, running, stored, text_or_empty


@dataclass(frozen=True)
class SecretRule:
    """Matches of ``pattern`` whose ``group`` has ``shortest`` or more characters. ``probe``: no match without it."""

    kind: str
    version: int
    pattern: str
    group: int
    shortest: int
    probe: str


# The kinds and patterns, in the order that breaks ties.
BASE_RULES = (
    SecretRule(
        "assign",
        1,
        "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        6,
        "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]",
    ),
    SecretRule("access", 1, "AKIA[A-Z0-9]+", 0, 20, "AKIA[A-Z0-9]{16}"),
    # Runs of these characters are matched whole, so shorter ones need not be listed to be dropped.
    SecretRule("hex", 1, "[0-9a-f]{24,}", 0, 24, "[0-9a-f]{24}"),
)
# Public formats of key blocks, signed web tokens and prefixed access tokens, beside the base kinds.
MORE_RULES = (
    SecretRule("pem", 1, "-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----", 0, 1, "PRIVATE KEY-----"),
    SecretRule("jwt", 1, "eyJ[A-Za-z0-9_-]{1,500}[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", 0, 1, "[.]eyJ"),
    SecretRule("prefixed", 1, "(?:gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|glpat-[A-Za-z0-9_-]{20})", 0, 1, "gh[pousr]_|xox[abprs]-|glpat-"),
)
RULES = BASE_RULES + MORE_RULES

FINDING = "struct<start:bigint,rank:int,end:bigint,kind:string>"


def find(text: Column, rule: SecretRule, rank: int) -> Column:
    """Array of findings (start, rank, end, kind) of one rule in a text; the end is exclusive."""
    length = lambda x: F.length(x).cast("bigint")
    none = F.array().cast(f"array<{FINDING}>")

    def spans(m: Column) -> Column:
        steps = F.transform(m["hits"], lambda h, k: length(F.get(m["gaps"], k)) + length(h))

        def placed(ends: Column) -> Column:
            every = F.transform(
                ends,
                lambda end, k: F.when(
                    F.length(F.get(m["groups"], k)) >= rule.shortest,
                    F.struct((end - length(F.get(m["hits"], k))).alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind")),
                ),
            )
            return F.filter(every, lambda x: x.isNotNull())

        return let(running(steps, F.lit(0).cast("bigint"), lambda a, x: a + x), placed)

    parts = F.struct(
        F.split(text, rule.pattern, -1).alias("gaps"),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("hits"),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)).alias("groups"),
    )
    return F.when(text.rlike(rule.probe), let(parts, spans)).otherwise(none)


def suspect(text: Column, rules: tuple[SecretRule, ...]) -> Column:
    """The text where some rule's probe fits it, else null."""
    any_probe = F.lit(False)
    for r in rules:
        any_probe = any_probe | text.rlike(r.probe)
    return F.when(any_probe, text)


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def scan_unseen(blobs: DataFrame, ledger: DataFrame | None, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """New ledger rows (blob, kind, version, findings) for distinct ``blobs`` (blob, text) and ``rules``. A null text is
    one that no probe fits."""
    due = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    if ledger is None:
        todo = blobs.withColumn("due", due)
    else:
        seen = ledger.groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("seen"))
        todo = (
            blobs.join(seen, "blob", "left")
            .withColumn("due", F.array_except(due, F.coalesce("seen", F.array().cast("array<struct<kind:string,version:int>>"))))
            .where(F.size("due") > 0)
        )
    results = [
        F.when(
            F.array_contains(F.col("due"), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"))),
            F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), find(F.col("text"), r, k).alias("findings")),
        )
        for k, r in enumerate(rules)
    ]
    return (
        todo.select("blob", F.explode(F.filter(F.array(*results), lambda x: x.isNotNull())).alias("r"))
        .select("blob", "r.kind", "r.version", "r.findings")
    )


def scan(
    docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[SecretRule, ...] = RULES, text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(paths, additions): ``docs`` without the text but with blob and findings; the rows to append to the ledger.

    ``docs`` may hold any number of paths and historical versions. ``findings`` is ordered by start, then by rule.
    """
    body = text_or_empty(text)
    blobs = docs.select(blob_of(body).alias("blob"), suspect(body, rules).alias("text")).dropDuplicates(["blob"])
    additions = stored(scan_unseen(blobs, ledger, rules), "secret-ledger")
    whole = additions if ledger is None else additions.unionByName(ledger)
    current = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    found = (
        whole.where(F.array_contains(current, F.struct("kind", "version")) & (F.size("findings") > 0))
        .groupBy("blob")
        .agg(F.sort_array(F.flatten(F.collect_set("findings"))).alias("findings"))
    )
    # A table, so that its true size decides the join, and so that a blob of a third of all paths can be split.
    found = stored(found, "secret-found")
    kept = [c for c in docs.columns if c not in (text, "blob", "findings")]
    paths = docs.select(*kept, blob_of(body).alias("blob")).join(found, "blob", "left")
    return (
        paths.select(*kept, "blob", F.coalesce("findings", F.array().cast(f"array<{FINDING}>")).alias("findings")),
        additions,
    )


def span_text(findings: Column) -> Column:
    """``kind:start:end`` of every finding, comma-joined."""
    return F.array_join(
        F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def masked(text: Column, findings: Column, mask: str = "[SECRET]", block: int = 4_096) -> Column:
    """The text with every finding, overlapping or touching ones merged, replaced by ``mask``. ``findings`` are ordered by start."""
    zero = F.lit(0).cast("bigint")

    def kept(m: Column) -> Column:
        """The text between findings: a mask ends where the largest end so far is left behind by the next start."""

        def piece(a: Column, b: Column) -> Column:
            first, last = F.floor(a / block).cast("int"), F.floor(b / block).cast("int")
            at = lambda x: (x % block).cast("int")
            one = F.get(m["blocks"], first).substr(at(a) + 1, (b - a).cast("int"))
            ends = F.concat(
                F.get(m["blocks"], first).substr(at(a) + 1, F.lit(block)),
                F.array_join(F.slice(m["blocks"], first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
                F.coalesce(F.get(m["blocks"], last).substr(F.lit(1), at(b)), F.lit("")),
            )
            return F.when(first == last, one).otherwise(ends)

        before = lambda k: F.when(k > 0, F.get(m["ends"], k - 1)).otherwise(zero)
        pieces = F.transform(
            findings,
            lambda x, k: F.when((k > 0) & (x["start"] <= before(k)), F.lit("")).otherwise(F.concat(F.when(x["start"] > before(k), piece(before(k), x["start"])).otherwise(F.lit("")), F.lit(mask))),
        )
        size, last = F.length(text).cast("bigint"), F.get(m["ends"], F.size(m["ends"]) - 1)
        rest = F.when(last < size, piece(last, size)).otherwise(F.lit(""))
        return F.concat(F.array_join(pieces, ""), rest)

    parts = F.struct(
        running(F.transform(findings, lambda x: x["end"]), zero, lambda a, x: F.greatest(a, x)).alias("ends"),
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0)).alias("blocks"),
    )
    return F.when(F.size(findings) > 0, let(parts, kept)).otherwise(text)


def redact(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """``docs`` with every finding masked in ``text``, by way of the ledger; ``n_chars``, if there, follows."""
    body = text_or_empty("text")
    blobs = docs.select(blob_of(body).alias("blob"), suspect(body, rules).alias("text")).dropDuplicates(["blob"])
    ledger = stored(scan_unseen(blobs, None, rules), "secret-ledger")
    found = (
        ledger.where(F.size("findings") > 0)
        .groupBy("blob")
        .agg(F.sort_array(F.flatten(F.collect_set("findings"))).alias("found"))
    )
    found = stored(found, "secret-found")
    whole = docs.select(F.struct("*").alias("row"), blob_of(body).alias("blob")).join(found, "blob", "left")
    text = F.when(F.size("found") > 0, masked(F.col("row")["text"], F.col("found"))).otherwise(F.col("row")["text"])
    columns = {c: F.col("row")[c] for c in docs.columns} | {"text": text}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.size("found") > 0, F.length(text).cast("long")).otherwise(F.col("row")["n_chars"])
    return whole.select(*[x.alias(c) for c, x in columns.items()])
