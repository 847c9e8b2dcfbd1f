"""Filter interaction audit: what each of several quality filters removes, alone and after others, in every order of application.

Words come as rows: texts are dealt out by document once, words explode where their document lies, and rows are aggregated by (document, word), then by document, both within
that same partitioning. The other flags, from characters and from copies elsewhere in the table, are joined to these totals by an outer join, as texts
without words have none. Each document's failures are then one of 2^F sets; documents of each set are counted in 2^F conditional columns for each part, and all orders of
the filters are read from these counts alone. So no order scans the documents again.

Copies: a document fails `copied` if a smaller key holds the same text anywhere in the table. The smallest key of each digest of 256 bits is found by one aggregation, and
documents meet it by (key, digest), which no group of copies makes hot: who doesn't match is a copy.

Defined results: null text is empty; rows of equal key, text and part are counted each, and are no copies of each other; a row of null key is no copy and
nothing is a copy of it; null parts are the empty string; labels repeated for a key count as one if any is 1; other columns are ignored; an empty table gives no rows. All expressions
are Spark's own.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SPACE = r"[\x20\x09-\x0D]+"
DOCUMENT = ["place", "k", "salt", "key", "part"]


def dealt(docs: DataFrame, text: str = "text", key: str = "doc_id", part: str = "source") -> DataFrame:
    """(place, k, salt, key, part, t): the documents dealt out by (place, k, salt), which tells documents apart. Rows repeated often differ by salt, the number of their first task."""
    k, t, p = F.col(key).cast("long"), F.coalesce(F.col(text).cast("string"), F.lit("")), F.coalesce(F.col(part).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(k, F.lit(0)).alias("place"), F.xxhash64(k, p, t).alias("k"), F.spark_partition_id().alias("salt"), k.alias("key"), p.alias("part"), t.alias("t"))
    return rows.repartition("place", "k", "salt")


def word_totals(rows: DataFrame) -> DataFrame:
    """(place, k, salt, words, distinct_words) of rows of `dealt`, over all rows that share these. All columns take part, so that the texts' one shuffle serves other flags too."""
    words = rows.select(*DOCUMENT, F.explode(F.split("t", SPACE)).alias("word")).where("word <> ''")
    counts = words.groupBy(*DOCUMENT, "word").agg(F.count("*").alias("n"))
    return counts.groupBy("place", "k", "salt").agg(F.sum("n").alias("words"), F.count("*").alias("distinct_words"))


def flagged(docs: DataFrame, text: str = "text", key: str = "doc_id", part: str = "source") -> DataFrame:
    """(key, part, n, short, repetitive, capitals, symbols, copied): n rows of a key and part that fail these filters."""
    rows = dealt(docs, text, key, part)
    capitals = F.length("t") - F.length(F.regexp_replace("t", "[A-Z]+", ""))
    marks = rows.select(*DOCUMENT, F.unhex(F.sha2("t", 256)).alias("digest"), (100 * capitals > 2 * F.length("t")).alias("capitals"), F.col("t").rlike("[#$%&*|]").alias("symbols"))
    marks = marks.groupBy(*marks.columns).agg(F.count("*").alias("n"))
    totals = marks.join(word_totals(rows), ["place", "k", "salt"], "left")
    words, distinct = F.coalesce("words", F.lit(0)) / F.col("n"), F.coalesce("distinct_words", F.lit(0))
    each = totals.select("key", "part", "digest", "n", (words < 200).alias("short"), (100 * distinct < 50 * words).alias("repetitive"), "capitals", "symbols")
    each = each.groupBy("key", "part", "digest", "short", "repetitive", "capitals", "symbols").agg(F.sum("n").alias("n"))
    each = written(each, "flags")
    first = each.groupBy("digest").agg(F.min("key").alias("key")).where("key is not null").withColumn("found", F.lit(True))
    copied = F.col("key").isNotNull() & F.col("found").isNull()
    return each.join(first, ["key", "digest"], "left").select("key", "part", "n", "short", "repetitive", "capitals", "symbols", copied.alias("copied"))


def interactions(flags: DataFrame, filters: dict[str, str], labels: DataFrame, weights: dict[str, str], key: str = "doc_id") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, a count for each weight, shapley) from rows (key, part, n, failure columns).

    `filters` names the failure column of each letter, at most 6; `weights` gives for each output column the label column whose value 1 counts among those removed at a step."""
    letters = list(filters)
    if not 1 <= len(letters) <= 6:
        raise ValueError("one to six filters")
    full = 1 << len(letters)
    failed = sum((F.when(F.col(filters[x]), 1 << i).otherwise(0) for i, x in enumerate(letters)), F.lit(0))
    sets = flags.select("key", "part", failed.alias("failed"), "n").groupBy("key", "part", "failed").agg(F.sum("n").alias("n"))
    known = labels.select(F.col(key).cast("long").alias("key"), *((F.col(c) == 1).cast("long").alias(f"w_{w}") for w, c in weights.items())).groupBy("key").agg(F.count("*").alias("rows"), *(F.max(f"w_{w}").alias(f"w_{w}") for w in weights))
    sets = sets.join(known, "key", "left")
    count = lambda m, w: F.coalesce(F.sum(F.when(F.col("failed") == m, F.col("n") * F.coalesce(w, F.lit(0)))), F.lit(0))
    cells = {"n": F.lit(1), **{w: F.col(f"w_{w}") for w in weights}}
    counts = sets.groupBy("part").agg(*(count(m, w).alias(f"{c}_{m}") for c, w in cells.items() for m in range(full)))

    def over(cell: str, chosen) -> Column:
        """The count of the failure sets that `chosen` picks by their bits."""
        return F.aggregate(F.array(*(F.struct(F.lit(m).alias("m"), F.col(f"{cell}_{m}").alias("x")) for m in range(full))), F.lit(0).cast("long"), lambda a, s: a + F.when(chosen(s["m"]), s["x"]).otherwise(0))

    orders = F.array(*(F.lit("".join(x)) for x in permutations(letters)))
    place = [F.instr("filter_order", x) for x in letters]
    rows = counts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
    bits = lambda chosen: sum((F.when(chosen(p), 1 << i).otherwise(0) for i, p in enumerate(place)), F.lit(0))
    rows = rows.withColumns({"bit": bits(lambda p: p == F.col("step")), "before": bits(lambda p: p < F.col("step"))})
    bit, before = F.col("bit"), F.col("before")
    fails = lambda m: m.bitwiseAND(bit) != 0
    reached = lambda m: m.bitwiseAND(before) == 0
    # A set's document is removed by one of its filters in equally many of all orders.
    shares = F.aggregate(F.array(*(F.struct(F.lit(m).alias("m"), (F.col(f"n_{m}") * (factorial(len(letters)) // m.bit_count())).alias("x")) for m in range(1, full))), F.lit(0).cast("long"), lambda a, s: a + F.when(fails(s["m"]), s["x"]).otherwise(0))
    return rows.select(
        "part", "filter_order", "step",
        over("n", lambda m: reached(m) & ~fails(m)).alias("kept"),
        over("n", lambda m: reached(m) & fails(m)).alias("removed"),
        over("n", lambda m: ~reached(m) & fails(m)).alias("redundant"),
        over("n", lambda m: m == bit).alias("unique_fails"),
        *(over(w, lambda m: reached(m) & fails(m)).alias(w) for w in weights),
        shares.alias("shapley"),
    )
