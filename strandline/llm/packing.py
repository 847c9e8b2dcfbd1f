"""Sequence packing: first-fit decreasing over a tournament tree of bin capacities, run apart in randomised groups.

Documents become token ids and one closing id, cut into full pieces of `size` and one rest. A hash deals all pieces into groups of about
GROUP pieces. Within a group, pieces go by falling length each into the first bin with room: the tree's leaves are the bins' free
places, its inner nodes their maxima, so that bin is found in log2(bins) steps. Groups never meet, so the one shuffle moves only what a
caller wants carried along, and a group's size doesn't grow with the corpus.

Defined results: null and empty texts are one closing id. Rows that repeat are packed each for itself, and spread over the groups.
White space of any length is fine.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP = 4096
#: Texts with white space of this length run in `tokenizers`: the other's splitter keeps a stack that grows with it and breaks at about a million.
LONG_SPACE = 1 << 16
SPACES = re.compile(rf"\s{{{LONG_SPACE}}}")
PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"


class Ids:
    """Ids of a text exactly as `tokenizers` gives them. A byte-level BPE file without normaliser, whose merges make ids in rising order, runs in the
    faster `tiktoken`, which then merges by the same ranks; any other file runs in `tokenizers` itself."""

    #: Fixed value: the splitting pattern of byte-level BPE.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.fast = None
        spec = json.load(open(path, encoding="utf-8"))
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        vocab = model.get("vocab", {})
        plain = model["type"] == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        made = [vocab["".join(m)] for m in merges]
        added = [t for t in spec.get("added_tokens", [])]
        if plain and all(a < b for a, b in pairwise(made)) and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added):
            import tiktoken

            letters = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
            back = {chr(b): b for b in letters} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(letters))}
            names = {t["content"]: t["id"] for t in added}
            ranks = {bytes(back[c] for c in token): i for token, i in vocab.items() if token not in names}
            self.fast = tiktoken.Encoding("packing", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens=names)
            self.names = tuple(names)

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or (len(text) >= LONG_SPACE and SPACES.search(text)):
            return self.exact.encode(text, add_special_tokens=False).ids
        if any(n in text for n in self.names):
            return self.fast.encode(text, allowed_special="all")
        return self.fast.encode_ordinary(text)


class Bins:
    """A tournament tree over bins in order of opening; its leaves are free places."""

    def __init__(self, most: int, size: int):
        self.width = 1 << max(0, math.ceil(math.log2(max(1, most))))
        self.free = [size] * (2 * self.width)

    def place(self, length: int) -> int:
        """Put a piece into the first bin with room and return the bin."""
        free, i = self.free, 1
        while i < self.width:
            i *= 2
            if free[i] < length:
                i += 1
        bin_ = i - self.width
        free[i] -= length
        while i > 1:
            i //= 2
            best = max(free[2 * i], free[2 * i + 1])
            if free[i] == best:
                break
            free[i] = best
        return bin_


def first_fit(lengths: list[int], size: int) -> list[int]:
    """The bin of each piece: by falling length, equal lengths in the order given."""
    bins, out = Bins(len(lengths), size), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        out[i] = bins.place(lengths[i])
    return out


def pieces(docs: DataFrame, tokenizer: str, size: int = 2048, end: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids) of each piece; ids are little-endian unsigned 32-bit numbers. A narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = Ids(tokenizer)
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = np.array([*(ids_of(t) if t else ()), end], "<u4")
                for i in range(0, len(raw), size):
                    part = raw[i : i + size]
                    rows.append((k, i, len(part), len(raw), part.tobytes()))
            c = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in c[:4]), pa.array(c[4], pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "ids"])

    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, PIECES)


def groups_for(docs: DataFrame, size: int = 2048, text: str = "text") -> int:
    """The number of groups for about GROUP pieces each, from the bytes of the texts."""
    n, total = docs.agg(F.count("*"), F.sum(F.octet_length(text))).first()
    return max(1, math.ceil((n + (total or 0) / (3 * size)) / GROUP))


def pack(rows: DataFrame, groups: int, size: int = 2048, length: str = "length") -> DataFrame:
    """The rows with sequence_id and offset; `length` is that of a piece, at most `size`. All columns are carried along, whatever they are;
    leave out those that need not move. A row's group is drawn by a hash of the row and of its place in the table, so equal rows, however many, spread
    like others; within a group, order is by the rows' own columns."""
    names = [c for c in rows.columns if c not in ("sequence_id", "offset", "pack_group")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(names, na_position="first", ignore_index=True)
        pdf["sequence_id"] = (int(pdf["pack_group"][0]) << 32) + np.array(first_fit(pdf[length].tolist(), size), np.int64)
        pdf["offset"] = pdf.groupby("sequence_id")[length].cumsum() - pdf[length]
        return pdf[[*names, "sequence_id", "offset"]]

    rows = rows.select(*names)
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", sequence_id long, offset long"
    return rows.withColumn("pack_group", F.pmod(F.xxhash64(*names, F.monotonically_increasing_id()), F.lit(groups))).groupBy("pack_group").applyInPandas(run, schema)
