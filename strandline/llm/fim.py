"""Fill-in-middle transformation: two cuts of a text at token boundaries, and the parts in a new order.

Tokens are runs of ASCII letters and all other code points one by one. So a token starts at each code point but a letter that follows a letter: a
predicate of adjacent characters alone, which holds for UTF-8 bytes too, as the bytes of other code points are no letters and all but the first of each are marked
as such. A text is cut into chunks that overlap by one byte, the predicate counts the starts in each chunk, the running sums of these counts give the
chunk that owns a cut's rank, and that chunk alone is scanned again for the cut's place. So no list of tokens or places is ever held, however long the text is. Every
row is cut where it lies; nothing is shuffled. Cuts come from digests of the key, so a task that is run again gives the same rows.

Defined results: null text is empty; empty texts, texts that hold a marker and the given share of others stay plain; a null key is hashed as an empty one;
repeated rows and equal keys are cut alike; other columns of the input stay, but those named like results of this operator are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of a chunk.
CHUNK = 1 << 14
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
#: Bytes that begin a code point.
LEAD = np.arange(256) & 0xC0 != 0x80


def starts(text: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Whether a token starts at each of the bytes from `begin` to `end`; the byte before them is read too."""
    letter = LETTER[text[max(0, begin - 1) : end]]
    after = letter[:-1] if begin else np.concatenate(([False], letter[:-1]))
    return LEAD[text[begin:end]] & ~(after & letter[-(end - begin) :])


def cut(text: np.ndarray, draws: tuple[int, int], chunk: int = CHUNK) -> tuple[int, int, int]:
    """(tokens, code points before the first cut, code points before the second) of UTF-8 bytes; the draws modulo the tokens plus one are the cuts' ranks."""
    begins = range(0, len(text), chunk)
    counts = np.array([[np.count_nonzero(starts(text, i, min(i + chunk, len(text)))), np.count_nonzero(LEAD[text[i : i + chunk]])] for i in begins], np.int64).reshape(-1, 2)
    tokens, points = (np.concatenate(([0], np.cumsum(c))) for c in counts.T)
    n = int(tokens[-1])
    places = []
    for rank in sorted(d % (n + 1) for d in draws):
        if rank == n:  # after the last token
            places.append(int(points[-1]))
            continue
        owner = int(np.searchsorted(tokens, rank, "right")) - 1
        begin, end = owner * chunk, min((owner + 1) * chunk, len(text))
        at = np.flatnonzero(starts(text, begin, end))[rank - tokens[owner]]
        places.append(int(points[owner]) + int(np.count_nonzero(LEAD[text[begin : begin + at]])))
    return n, places[0], places[1]


PLACES = StructType([StructField(x, LongType()) for x in ("n", "first", "second")])


def cuts(text: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
    text = text.cast(pa.large_string())
    ends = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8) if len(text) else np.zeros(1, np.int64)
    data = np.frombuffer(text.buffers()[2], np.uint8) if len(text) and text.buffers()[2] else np.zeros(0, np.uint8)
    rows = [cut(data[i:j], d) for i, j, *d in zip(ends[:-1], ends[1:], a.to_pylist(), b.to_pylist(), strict=True)]
    columns = np.array(rows, np.int64).reshape(-1, 3).T
    return pa.StructArray.from_arrays([pa.array(c) for c in columns], names=PLACES.names)


def transform(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 1, plain: int = 10, spm: int = 20) -> DataFrame:
    """The input with n (tokens), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain) and output. `plain` percent of the texts stay as
    they are, and `spm` percent of the others take the suffix first."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    draw = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    marked = F.contains(whole, F.lit(PREFIX)) | F.contains(whole, F.lit(SUFFIX)) | F.contains(whole, F.lit(MIDDLE))
    as_it_is = (whole == "") | marked | (draw[2] % 100 >= 100 - plain)
    form = F.when(as_it_is, F.lit("plain")).when(draw[3] % 100 < spm, F.lit("spm")).otherwise(F.lit("psm"))
    rows = docs.drop(*({"n", "form", "prefix_chars", "middle_chars", "output"} - {text, key})).select("*", F.arrow_udf(cuts, PLACES)(whole, draw[0], draw[1]).alias("__cuts"))
    first, second = F.col("__cuts.first"), F.col("__cuts.second")
    part = lambda at, length: F.substring(whole, at.cast("int") + 1, length.cast("int"))
    prefix, middle, suffix = part(F.lit(0), first), part(first, second - first), part(second, F.lit(2**31 - 1))
    output = F.when(form == "plain", whole).when(form == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
    output = output.otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    moved = lambda x: F.when(form != "plain", x)
    return rows.withColumns({"n": F.col("__cuts.n"), "form": form, "prefix_chars": moved(first), "middle_chars": moved(second - first), "output": output}).drop("__cuts")


def restored(output: str | Column = "output", form: str | Column = "form") -> Column:
    """The text before the transformation, from its output and form alone: a text that holds a marker is plain, so markers part the others unmistakably."""
    output, form = (F.col(x) if isinstance(x, str) else x for x in (output, form))
    part = F.split(output, "<[PSM]>", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))
