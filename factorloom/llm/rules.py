"""Quality rules: a threshold table compiled into one Spark projection.

Nulls: a null text has no words and fails. Empty texts fail. Repeated rows are judged one by one. An empty table
gives an empty table. Columns of the input that clash with a result column are replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, let, text_or_empty, words_of

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that for with on by this was be are at from a an or not as it "
    "der die das und den von zu mit für auf ist im dem ein eine nicht sich als auch es des "
    "le la les de du et en un une est que qui dans pour sur au avec pas par ce il "
    "el los las y del se con por para su lo al no una"
).split()


@dataclass(frozen=True)
class Threshold:
    """``low <= numerator / denominator <= high``, as whole numbers over ``scale`` so that no rounding decides."""

    name: str
    numerator: str
    denominator: str | None = None
    low: int | None = None
    high: int | None = None
    scale: int = 100

    def holds(self, measure: Column) -> Column:
        top = measure[self.numerator] * (self.scale if self.denominator else 1)
        base = measure[self.denominator] if self.denominator else F.lit(1)
        ok = F.lit(True)
        if self.low is not None:
            ok = ok & (top >= base * self.low)
        if self.high is not None:
            ok = ok & (top <= base * self.high)
        return ok


#: The table. Ratios are percentages of the denominator.
THRESHOLDS = (
    Threshold("length", "n_words", low=50),
    Threshold("word length", "word_chars", "n_words", low=200, high=1_200),
    Threshold("symbols", "n_symbols", "n_words", high=10),
    Threshold("stop words", "n_stop_words", "n_words", low=5),
    Threshold("repeated words", "n_repeat_words", "n_words", high=50),
    Threshold("repeated lines", "n_dup_lines", "n_lines", high=50),
    Threshold("bullet lines", "n_bullet_lines", "n_lines", high=90),
    Threshold("cut lines", "n_ellipsis_lines", "n_lines", high=30),
)


def _covered(starts: Column, width: int) -> Column:
    """How many positions the windows of ``width`` at the ascending ``starts`` cover."""
    n = F.size(starts)
    steps = F.transform(
        starts, lambda p, k: F.when(k == n - 1, F.lit(width)).otherwise(F.least(F.lit(width), F.get(starts, k + 1) - p))
    )
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)


def repeated_words(words: Column, width: int = 3) -> Column:
    """Words inside windows of ``width`` words that occur twice or more in the text, first occurrences included."""

    def of_sorted(s: Column) -> Column:
        n = F.size(s)
        twin = F.filter(
            s,
            lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < n - 1) & (F.get(s, k + 1)["h"] == x["h"])),
        )
        return let(F.sort_array(F.transform(twin, lambda x: x["i"])), lambda p: _covered(p, width))

    def of_hashes(h: Column) -> Column:
        indexed = F.transform(h, lambda x, k: F.struct(x.alias("h"), k.alias("i")))
        repeats = F.size(F.array_distinct(h)) < F.size(h)
        return F.when(repeats, let(F.sort_array(indexed), of_sorted)).otherwise(F.lit(0).cast("long"))

    starts = F.sequence(F.lit(0), F.size(words) - width)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
    return F.when(F.size(words) >= width, let(hashes, of_hashes)).otherwise(F.lit(0).cast("long"))


def measures(text: Column) -> Column:
    """One struct with every count that the table refers to, from one pass over the words and one over the lines."""
    long = "long"
    full = text_or_empty(text)

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast(long).alias("n_words"),
            F.aggregate(w, F.lit(0).cast(long), lambda a, x: a + F.length(x)).alias("word_chars"),
            F.size(F.filter(w, lambda x: x.isin(STOP_WORDS))).cast(long).alias("n_stop_words"),
            repeated_words(w).alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast(long).alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast(long).alias("n_dup_lines"),
            F.size(F.filter(lines, lambda x: x.rlike("^[\\x20\\x09]*[-*\\u2022\\u00B7]"))).cast(long).alias("n_bullet_lines"),
            F.size(F.filter(lines, lambda x: x.rlike("(\\.\\.\\.|\\u2026)[\\x20\\x09-\\x0D]*$"))).cast(long).alias("n_ellipsis_lines"),
        )

    lines = F.filter(F.split(full, "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]"))
    symbols = (F.length(full) - F.length(F.regexp_replace(full, "[#*$%&|<>]+", ""))).cast(long)
    return let(
        F.struct(let(words_of(full), of_words).alias("w"), let(lines, of_lines).alias("l"), symbols.alias("s")),
        lambda m: F.struct(
            *[m["w"][c].alias(c) for c in ("n_words", "word_chars", "n_stop_words", "n_repeat_words")],
            *[m["l"][c].alias(c) for c in ("n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines")],
            m["s"].alias("n_symbols"),
        ),
    )


def judge(docs: DataFrame, text: str = "text", thresholds: tuple[Threshold, ...] = THRESHOLDS) -> DataFrame:
    """``docs`` with a struct ``quality``: every measure, the names of the rules broken, and the verdicts."""

    def verdict(m: Column) -> Column:
        broken = F.filter(
            F.array(*[F.when(~t.holds(m), F.lit(t.name)) for t in thresholds]), lambda x: x.isNotNull()
        )
        base_failed = (m["n_words"] < 50) | (m["n_repeat_words"] * 100 > m["n_words"] * 50)
        return F.struct(
            m.alias("measures"),
            broken.alias("broken"),
            base_failed.alias("base_failed"),
            (~base_failed & (F.size(broken) == 0)).alias("kept"),
        )

    return docs.withColumn("quality", let(measures(F.col(text)), verdict))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows that break no rule, with the columns of the input."""
    columns = docs.columns
    judged = judge(docs.select(F.struct("*").alias("row"), F.col("text").alias("text")))
    return judged.where("quality.kept").select(*[F.col("row")[c].alias(c) for c in columns])
