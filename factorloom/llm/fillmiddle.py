"""Fill-in-the-middle: texts cut twice between units and put in another order.

Units are runs of ASCII letters and single other characters, so a text is all of its units, in order. They are handled as
relations. The units of a text come in runs of 32; a run in which no cut is asked for stays one row with its length, the units
of the others are rows of their own. ``posexplode`` makes the rows, a window adds up lengths before each, the requested cuts
meet them by the ordinal of the unit that begins there, and what they find becomes one row of offsets for each document, with
which its text is cut by ``substring``. Repeated rows are one document up to there, merged before they are shuffled. A text is
shuffled once, to meet its offsets; what is counted and sorted is one row for each 32 units and for each unit of two runs.

Both cuts of a document depend on its id, the seed and the number of its units alone, so runs repeat. Rows are told apart by id
and by the length and a 64-bit hash of the text.

Nulls: a null text counts as empty, and an empty text stays as it is (``plain``), like a text that contains a marker. A null
``doc_id`` is an empty string to the digest. Repeated rows give the same result, once for each. Empty tables give empty tables. A
column named ``fim`` is replaced, all others are carried along. Texts of any length are cut; a word of any length is one unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_or_empty

UNIT = "[A-Za-z]+|[^A-Za-z]"
RUN_UNITS = 32
#: As many units as make a run. Possessive, so that nothing is tried twice.
RUN = f"(?:[A-Za-z]++|[^A-Za-z]){{1,{RUN_UNITS}}}+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
PLAIN_FROM, SPM_BELOW = 90, 20
KEY = ("id_key", "content")


def _draw(k: int, seed: int) -> Column:
    """The k-th group of eight digits of the digest of seed and id, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``body``, its text or an empty one, and a key of two hashes."""
    named = docs.withColumn("body", text_or_empty(F.col("text").cast("string")))
    return named.withColumn("id_key", F.xxhash64("doc_id")).withColumn("content", F.xxhash64("body", F.col("doc_id").isNull()))


def requests(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(id_key, content, n, form, first, second, runs): the cuts asked for, after so many units, and the lengths of the units, in
    order; that of a run that stays whole is negative. One row for each different document. Plain ones have no runs."""
    n = F.when(F.size("parts") > 0, (F.size("parts") - 1) * F.lit(RUN_UNITS).cast("long") + F.regexp_count(F.element_at("parts", -1), F.lit(UNIT))).otherwise(F.lit(0)).cast("long")
    marked = F.col("body").contains(PREFIX) | F.col("body").contains(SUFFIX) | F.col("body").contains(MIDDLE)
    form = F.when((F.col("body") == "") | marked | (_draw(2, seed) % 100 >= PLAIN_FROM), "plain").when(_draw(3, seed) % 100 < SPM_BELOW, "spm").otherwise("psm")
    rows = _keyed(docs.select("doc_id", "text")).withColumn("parts", F.regexp_extract_all("body", F.lit(RUN), F.lit(0)))
    rows = rows.withColumn("n", n).withColumn("form", form)
    a, b = _draw(0, seed) % (F.col("n") + 1), _draw(1, seed) % (F.col("n") + 1)
    rows = rows.withColumn("first", F.least(a, b)).withColumn("second", F.greatest(a, b))
    at_first, at_second = (F.expr(f"cast({c} div {RUN_UNITS} as int)") for c in ("first", "second"))

    def of_run(part: Column, i: Column) -> Column:
        units = F.transform(F.regexp_extract_all(part, F.lit(UNIT), F.lit(0)), F.length)
        return F.when((i == at_first) | (i == at_second), units).otherwise(F.array(-F.length(part)))

    runs = F.when(F.col("form") != "plain", F.flatten(F.transform(F.slice("parts", F.lit(1), at_second + 1), of_run)))
    rows = rows.select(*KEY, "n", "form", "first", "second", runs.alias("runs"))
    return rows.groupBy(*KEY).agg(*[F.any_value(c).alias(c) for c in ("n", "form", "first", "second", "runs")])


def offsets(asked: DataFrame) -> DataFrame:
    """(id_key, content, n, form, first_at, second_at) of ``requests``: where its cuts are, in code points. They are null for a
    plain document and for a cut at the end of the text."""
    # Dealt by the key before rows multiply, and not again after that.
    asked = asked.repartition(*KEY)
    before = Window.partitionBy(*KEY).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda x: F.coalesce(F.sum(x).over(before), F.lit(0).cast("long"))
    units = asked.select(*KEY, F.posexplode("runs").alias("place", "chars"))
    units = units.select(*KEY, upto(F.when(F.col("chars") < 0, RUN_UNITS).otherwise(1)).alias("ordinal"), upto(F.abs("chars")).alias("at"))
    cuts = asked.where("form != 'plain'").select(*KEY, F.posexplode(F.array("first", "second")).alias("cut", "wanted"))
    # The difference keeps the ordinal out of the keys of the join, for which both sides would be dealt anew.
    met = cuts.join(units.hint("merge"), list(KEY)).where(F.col("wanted") - F.col("ordinal") == 0)
    found = met.groupBy(*KEY).agg(*[F.max(F.when(F.col("cut") == k, F.col("at"))).alias(f"{name}_at") for k, name in enumerate(("first", "second"))])
    return asked.select(*KEY, "n", "form").join(found.hint("merge"), list(KEY), "left")


def restored(output: Column, form: Column) -> Column:
    """The text again, from what was made of it and its form. The text holds no marker, so each marker's first place is its own."""
    body = F.substring(output, F.lit(len(PREFIX) + 1), F.length(output))
    inner = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    i, j = F.locate(SUFFIX, body), F.locate(PREFIX, body)
    k, end = F.when(form == "psm", i).otherwise(j), F.locate(MIDDLE, body)
    left = F.substring(body, F.lit(1), k - 1)
    right = F.substring(body, k + F.length(inner), end - k - F.length(inner))
    middle = F.substring(body, end + len(MIDDLE), F.length(body))
    prefix, suffix = F.when(form == "psm", left).otherwise(right), F.when(form == "psm", right).otherwise(left)
    return F.when(form == "plain", output).otherwise(F.concat(prefix, middle, suffix))


def fill_in_middle(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` with ``fim``: struct(n units, form, prefix_chars, middle_chars, output). ``docs`` is read twice."""
    places = offsets(stored(requests(docs, seed), "fim-requests"))
    named = {c: f"fim_{c}" for c in places.columns}
    rows = _keyed(docs.select(F.struct(*[c for c in docs.columns if c != "fim"]).alias("row"), "doc_id", "text")).select("row", *KEY)
    rows = rows.join(places.withColumnsRenamed(named).hint("merge"), (F.col("id_key") == F.col("fim_id_key")) & (F.col("content") == F.col("fim_content")))
    # Only now, or the text would be shuffled twice over.
    rows = rows.withColumn("body", text_or_empty(F.col("row.text").cast("string")))
    cut = F.col("fim_form") != "plain"
    size = F.length("body").cast("long")
    rows = rows.withColumn("fim_a", F.when(cut, F.coalesce("fim_first_at", size))).withColumn("fim_b", F.when(cut, F.coalesce("fim_second_at", size)))
    a, b = F.col("fim_a").cast("int"), F.col("fim_b").cast("int")
    prefix, middle = F.substring("body", F.lit(1), a), F.substring("body", a + 1, b - a)
    suffix = F.substring("body", b + 1, F.length("body"))
    psm, spm = [F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix], [F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix]
    output = F.when(~cut, F.col("body")).when(F.col("fim_form") == "psm", F.concat(*psm, F.lit(MIDDLE), middle)).otherwise(F.concat(*spm, F.lit(MIDDLE), middle))
    fim = F.struct(F.col("fim_n").alias("n"), F.col("fim_form").alias("form"), F.col("fim_a").alias("prefix_chars"), (F.col("fim_b") - F.col("fim_a")).alias("middle_chars"), output.alias("output"))
    return rows.select("row", fim.alias("fim")).select("row.*", "fim")
