"""Exact removal of repeated byte strings by longest-previous-factor arrays.

A byte goes if some WIDTH-byte string that covers it also starts in a document of smaller id. In the suffix array of a set of texts, the previous and the next
suffix of smaller document are those that share most with a suffix among all suffixes of smaller documents, so the longer of their common prefixes with it is its
longest previous factor by document. Where that reaches WIDTH, the string goes: first copies stay and all later ones go. The array orders
suffixes by DEPTH bytes, as longer factors change nothing; the neighbours come from pointers that jump over suffixes of documents no smaller.

One suffix order over a whole corpus would not be many tasks, so it is built in two steps over blocks of documents:

1.  Each string has an owner: the least hash of the GRAM-byte grams within it. Equal strings have equal owners, and neighbouring strings mostly share
    theirs, so a block's owners are about a fourteenth of its bytes. Owners meet by hash (32 bits of each, in packed arrays) to learn which occur in
    more than one block.
2.  A block builds the suffix order of its strings with a shared owner and marks those that a smaller document of the block holds. What is left with an
    owner that another block has too goes, as runs of strings with their bytes, to the part that its owner's hash names, where one more
    suffix order marks what a smaller document of any block holds.

Before a part builds its order, runs of equal bytes become one run of their smallest document, as most runs are copies of each other.

Hashes only choose what is compared; every match is between bytes. A string in very many documents is sent once by each block at most, so neither
copies nor frequent passages gather in a task; blocks and parts have bounded sizes. All steps read the one exchange that deals documents into blocks.

Defined results: null texts are empty; texts shorter than WIDTH keep all; rows of equal id never match each other; rows of null id
match nothing and keep all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, GRAM = 50, 25
#: Bytes by which suffixes are ordered.
DEPTH = 64
#: Bytes of text of a block, of owners of a part, and of a piece that is hashed at a time.
BLOCK, PART, PIECE = 2 << 20, 3 << 20, 1 << 17
BASE = 0x9E3779B97F4A7C15 | 1
MAIL = "part int, block int, data binary"


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    out = x
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(out) - (width - have)], out[width - have :])
    return out


def owners(text: np.ndarray) -> np.ndarray:
    """The owner of each WIDTH-byte string of one piece."""
    up, down = powers(PIECE + WIDTH)
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[: len(text)], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * down[: len(text) - GRAM + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return sliding_min(h, WIDTH - GRAM + 1)


class Block:
    """Documents of a block in order of id and text, whole texts side by side. Rows: (id or None, text)."""

    def __init__(self, rows: list[tuple[int | None, bytes]]):
        self.rows = rows
        live = [k for k, (i, t) in enumerate(rows) if i is not None and len(t) >= WIDTH]
        self.live = np.array(live, np.int64)
        self.ids = np.array([rows[k][0] for k in live], np.int64)
        sizes = np.array([len(rows[k][1]) for k in live], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.text = np.frombuffer(b"".join(rows[k][1] for k in live), np.uint8)
        at, doc, own = [], [], []
        for a, b, lo, hi in self.pieces():
            o = owners(self.text[a:b])
            p = np.arange(a, a + len(o))
            d = np.searchsorted(self.ends[lo:hi], p, "right") + lo
            good = p + WIDTH <= self.ends[d]
            at.append(p[good])
            doc.append(d[good])
            own.append(o[good])
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.at, self.doc, self.own = cat(at, np.int64), cat(doc, np.int64), cat(own, np.uint64)
        # Runs: neighbouring strings of a document with one owner.
        new = np.ones(len(self.at), np.bool_)
        new[1:] = (self.own[1:] != self.own[:-1]) | (self.doc[1:] != self.doc[:-1]) | (self.at[1:] != self.at[:-1] + 1)
        self.run = np.cumsum(new) - 1
        heads = np.flatnonzero(new)
        run_own, run_doc = self.own[heads], self.doc[heads]
        order = np.argsort(run_own, kind="stable")
        o, d = run_own[order], run_doc[order]
        first_of = np.ones(len(o), np.bool_)
        first_of[1:] = o[1:] != o[:-1]
        self.names = o[first_of]  # distinct owners, rising
        number = np.cumsum(first_of) - 1
        self.name_of_run = np.empty(len(o), np.int64)
        self.name_of_run[order] = number
        edge = np.flatnonzero(first_of)
        self.several = np.minimum.reduceat(d, edge) != np.maximum.reduceat(d, edge) if len(o) else np.zeros(0, np.bool_)

    def pieces(self) -> Iterator[tuple[int, int, int, int]]:
        """(from, to, first document, last document + 1): short documents together, long ones in pieces that overlap by WIDTH - 1."""
        k = 0
        while k < len(self.ends):
            a = int(self.starts[k])
            j = max(k + 1, int(np.searchsorted(self.ends, a + PIECE, "right")))
            end = int(self.ends[j - 1])
            for i in range(a, max(a + 1, end - WIDTH + 1), PIECE):
                b = min(end, i + PIECE + WIDTH - 1)
                if b - i >= WIDTH:
                    yield i, b, k, j
            k = j

    def by_part(self, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct owners in order of part, and where each part ends."""
        part = (self.names % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        return order, np.cumsum(np.bincount(part, minlength=parts))


def dense(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    out = np.empty(len(keys), np.uint64)
    k = keys[order]
    out[order] = np.cumsum(np.concatenate(([False], k[1:] != k[:-1]))).astype(np.uint64)
    return out


def previous_smaller(x: np.ndarray) -> np.ndarray:
    """For each place, the last one before it with a smaller value, or -1. Whatever a pointer has passed is no smaller than its own value, so a pointer
    that rests on a value no smaller may go where that one's points; all jump at once."""
    at = np.arange(-1, len(x) - 1)
    open_ = np.flatnonzero((at >= 0) & (x[at] >= x))
    while len(open_):
        at[open_] = at[at[open_]]
        to = at[open_]
        open_ = open_[(to >= 0) & (x[to] >= x[open_])]
    return at


def longest_previous(text: np.ndarray, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The longest previous factor of the suffix at each place: the most bytes that it shares with a suffix of smaller document, up to DEPTH. `doc` are ranks."""
    if not len(at):
        return np.zeros(0, np.int64)
    x = np.concatenate((text, np.zeros(2 * DEPTH, np.uint8))).astype(np.uint64)
    x = x[:-1] << np.uint64(8) | x[1:]
    x = x[:-2] << np.uint64(16) | x[2:]
    x = x[:-4] << np.uint64(32) | x[4:]  # eight bytes from each place
    # Ranks of 8, 16 and 32 bytes, each from two of the last, and the suffix array by DEPTH bytes from two of the latter.
    ranks = {8: dense(x[: len(text) + DEPTH + 56])}
    for n in (16, 32):
        r = ranks[n // 2]
        ranks[n] = dense(r[: -n // 2] << np.uint64(32) | r[n // 2 :])
    r = ranks[32]
    order = np.argsort(r[at] << np.uint64(32) | r[at + 32])
    p, d = at[order], doc[order]
    before = previous_smaller(d)
    after = len(d) - 1 - previous_smaller(d[::-1])[::-1]
    best = np.zeros(len(at), np.int64)
    for other, there in ((before, before >= 0), (after, after < len(d))):
        i = np.flatnonzero(there)
        a, b, n = p[i], p[other[i]], np.zeros(len(i), np.int64)
        for step in (32, 16, 8):
            n += step * (ranks[step][a + n] == ranks[step][b + n])
        differ = x[a + n] ^ x[b + n]
        n += sum(differ < np.uint64(1 << k) for k in range(0, 64, 8))  # its leading zero bytes
        best[i] = np.maximum(best[i], n)
    out = np.empty(len(at), np.int64)
    out[order] = best
    return out


def repeated(text: np.ndarray, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether the WIDTH bytes at each place also start at a place of smaller document."""
    return longest_previous(text, at, doc) >= WIDTH


def pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(a) for a in arrays], np.int64).tobytes()
    return zstd.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def unpack(data: bytes, *types) -> list[np.ndarray]:
    raw = zstd.ZstdDecompressor().decompress(data)
    sizes, at, out = np.frombuffer(raw, np.int64, len(types)), 8 * len(types), []
    for n, t in zip(sizes.tolist(), types, strict=True):
        out.append(np.frombuffer(raw, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


def ranges(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring places of a document as (document, first, how many)."""
    new = np.ones(len(at), np.bool_)
    new[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)
    heads = np.flatnonzero(new)
    return doc[heads], at[heads], np.diff(np.append(heads, len(at)))


def block_of(table: pa.Table) -> tuple[Block, list[int]]:
    rows = [(i, t or b"") for i, t in zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True)]
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is None, rows[r][0] or 0, rows[r][1]))
    return Block([rows[r] for r in order]), order


def mail(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    c = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.table({"part": pa.array(c[0], pa.int32()), "block": pa.array(c[1], pa.int32()), "data": pa.array(c[2], pa.binary())})


def ask(table: pa.Table, parts: int) -> pa.Table:
    """Step 1, of a block: its owners to their parts, 32 bits of each."""
    b, _ = block_of(table)
    order, ends = b.by_part(parts)
    low = (b.names[order] // np.uint64(parts) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    number = table["block"][0].as_py()
    return mail([(p, number, x.tobytes()) for p, x in enumerate(np.split(low, ends[:-1])) if len(x)])


def answer(table: pa.Table) -> pa.Table:
    """Step 1, of a part: which owners more than one block has, a bit each, to their blocks."""
    rows = sorted(zip(table["block"].to_pylist(), table["data"].to_pylist(), strict=True))
    given = [np.frombuffer(d, np.uint32) for _, d in rows]
    every = np.sort(np.concatenate(given))
    twice = every[1:][every[1:] == every[:-1]]
    out, part = [], table["part"][0].as_py()
    for (block, _), x in zip(rows, given, strict=True):
        i = np.searchsorted(twice, x)
        out.append((part, block, np.packbits((i < len(twice)) & (twice[np.minimum(i, len(twice) - 1)] == x) if len(twice) else np.zeros(len(x), np.bool_)).tobytes()))
    return mail(out)


def tell(table: pa.Table, answers: pa.Table, parts: int) -> pa.Table:
    """Step 2, of a block: mark what its own smaller documents hold; send the rest with owners that other blocks have."""
    if not table.num_rows:
        return mail([])
    b, _ = block_of(table)
    number = table["block"][0].as_py()
    order, ends = b.by_part(parts)
    starts = np.concatenate(([0], ends[:-1]))
    abroad = np.zeros(len(b.names), np.bool_)
    for p, bits in zip(answers["part"].to_pylist(), answers["data"].to_pylist(), strict=True):
        n = int(ends[p] - starts[p])
        abroad[order[starts[p] : ends[p]]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(np.bool_)
    marked = np.zeros(len(b.at), np.bool_)
    near = np.flatnonzero((abroad | b.several)[b.name_of_run][b.run]) if len(b.at) else np.zeros(0, np.int64)
    if len(near):
        edge = np.zeros(len(b.text) + 1, np.int64)
        np.add.at(edge, b.at[near], 1)
        np.add.at(edge, b.at[near] + WIDTH, -1)
        held = np.cumsum(edge[:-1]) > 0
        place = np.cumsum(held) - 1
        ids = np.sort(b.ids)
        marked[near] = repeated(b.text[held], place[b.at[near]], np.searchsorted(ids, b.ids)[b.doc[near]])
    at, doc = b.at[marked], b.doc[marked]
    d, first, count = ranges(doc, at)
    out = [(-1 - number, number, pack(b.live[d], first - b.starts[d], count.astype(np.int64)))]
    left = np.flatnonzero(~marked & abroad[b.name_of_run][b.run]) if len(b.at) else np.zeros(0, np.int64)
    if len(left):
        new = np.ones(len(left), np.bool_)
        new[1:] = (b.run[left][1:] != b.run[left][:-1]) | (b.at[left][1:] != b.at[left][:-1] + 1)
        heads = np.flatnonzero(new)
        count = np.diff(np.append(heads, len(left)))
        head = left[heads]
        own, doc, first = b.own[head], b.doc[head], b.at[head]
        part = (own % np.uint64(parts)).astype(np.int64)
        by = np.lexsort((own, part))
        for p, group in groupby(np.split(by, np.flatnonzero(np.diff(part[by])) + 1), key=lambda g: int(part[g[0]])):
            g = next(group)
            n = count[g] + WIDTH - 1
            index = np.repeat(first[g] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            out.append((p, number, pack(own[g], b.ids[doc[g]], b.live[doc[g]], first[g] - b.starts[doc[g]], count[g].astype(np.int64), b.text[index])))
    return mail(out)


def settle(table: pa.Table) -> pa.Table:
    """Step 2, of a part: mark, in the runs of strings that blocks sent, what a smaller document holds."""
    part = table["part"][0].as_py()
    if part < 0:  # a block's word to itself
        return table.select(["part", "block", "data"])
    got = sorted(zip(table["block"].to_pylist(), table["data"].to_pylist(), strict=True))
    sent = [unpack(d, np.uint64, np.int64, np.int64, np.int64, np.int64, np.uint8) for _, d in got]
    own, ids, row, first, count, text = (np.concatenate([s[i] for s in sent]) for i in range(6))
    block = np.repeat(np.array([b for b, _ in got], np.int64), [len(s[0]) for s in sent])
    del sent
    ends = np.cumsum(count + WIDTH - 1)
    starts = ends - count - WIDTH + 1
    # Runs of the same bytes are one class, held by its smallest document; others' strings are all repeated.
    raw, classes = text.tobytes(), {}
    cls = np.fromiter((classes.setdefault(raw[a:e], len(classes)) for a, e in zip(starts.tolist(), ends.tolist(), strict=True)), np.int64, len(own))
    del raw
    least = np.full(len(classes), np.iinfo(np.int64).max)
    np.minimum.at(least, cls, ids)
    model = np.zeros(len(classes), np.int64)  # a run of each class
    model[cls[::-1]] = np.arange(len(own))[::-1]
    by = np.argsort(own[model], kind="stable")
    o = own[model][by]
    same = np.zeros(len(by), np.bool_)
    if len(by) > 1:
        same[1:] |= o[1:] == o[:-1]
        same[:-1] |= o[1:] == o[:-1]
    several = np.sort(by[same])  # classes that share an owner with another one: compare string by string
    pos, many = starts[model[several]], count[model[several]]
    length = many + WIDTH - 1
    base = np.cumsum(length) - length
    chosen = text[np.repeat(pos - base, length) + np.arange(int(length.sum()))] if len(several) else np.zeros(0, np.uint8)
    inner = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    values = np.sort(least[several])
    hit = repeated(chosen, np.repeat(base, many) + inner, np.repeat(np.searchsorted(values, least[several]), many))
    hits: dict[int, np.ndarray] = {}
    if hit.any():
        for c, h in zip(several.tolist(), np.split(hit, np.cumsum(many)[:-1]), strict=True):
            if h.any():
                hits[c] = np.flatnonzero(h)
    back: dict[int, list[tuple]] = {}
    later = ids > least[cls]
    for i in np.flatnonzero(later).tolist():
        back.setdefault(int(block[i]), []).append((row[i], first[i], count[i]))
    for i in np.flatnonzero(~later & np.isin(cls, np.fromiter(hits, np.int64, len(hits)))).tolist():
        h = hits[int(cls[i])]
        _, f, n = ranges(np.zeros(len(h), np.int64), h)
        back.setdefault(int(block[i]), []).extend((row[i], first[i] + a, m) for a, m in zip(f.tolist(), n.tolist(), strict=True))
    return mail([(part, b, pack(*(np.array(c, np.int64) for c in zip(*v, strict=True)))) for b, v in back.items()])


def spans_of(size: int, first: np.ndarray, count: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the marked strings cover."""
    order = np.argsort(first, kind="stable")
    a, e = first[order], first[order] + count[order] + WIDTH - 1
    e = np.maximum.accumulate(e)
    new = np.ones(len(a), np.bool_)
    new[1:] = a[1:] > e[:-1]
    heads = np.flatnonzero(new)
    return list(zip(a[heads].tolist(), np.minimum(e[np.append(heads[1:], len(a)) - 1], size).tolist(), strict=True))


def whole_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without the parts of characters at their ends."""
    inside = lambda p: p < len(text) and text[p] & 0xC0 == 0x80
    out = []
    for a, e in spans:
        while a < e and inside(a):
            a += 1
        while e > a and inside(e):
            e -= 1
        if e > a:
            out.append((a, e))
    return out


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, e in spans:
        out.append(text[at:a])
        at = e
    return b"".join([*out, text[at:]])


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", carry: tuple[str, ...] = (), characters: bool = False) -> DataFrame:
    """(doc_id, n_bytes, spans, kept, *carry) of each row: the removed spans (start, end) in bytes, and the bytes that stay. `carry` names further columns to
    keep. With `characters`, spans are drawn in to whole UTF-8 characters, so that what stays is valid text."""
    spark = docs.sparkSession
    total, n = docs.agg(F.sum(F.octet_length(text)), F.count("*")).first()
    blocks, parts = max(1, math.ceil((total or 0) / BLOCK)), max(1, math.ceil(0.3 * (total or 0) / PART))
    kept = [F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)]
    rows = docs.select(F.pmod(F.xxhash64(key, F.octet_length(text)), F.lit(blocks)).cast("int").alias("block"), F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string").cast("binary"), F.lit(b"")).alias("text"), *kept)
    rows = rows.repartition(max(blocks // 4, int(spark.conf.get("spark.sql.shuffle.partitions"))), "block")

    def finish(table: pa.Table, word: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({f.name: pa.array([], f.type) for f in out_types(table)})
        ids, texts = table["doc_id"].to_pylist(), table["text"].to_pylist()
        order = sorted(range(len(ids)), key=lambda r: (ids[r] is None, ids[r] or 0, texts[r]))
        said = [unpack(d, np.int64, np.int64, np.int64) for d in word["data"].to_pylist()] or [[np.zeros(0, np.int64)] * 3]
        row, first, count = (np.concatenate([s[i] for s in said]) for i in range(3))
        by = np.argsort(row, kind="stable")
        row, first, count = row[by], first[by], count[by]
        edges = np.searchsorted(row, np.arange(len(order) + 1))
        spans = [[]] * len(order)
        for k, r in enumerate(order):
            a, e = edges[k], edges[k + 1]
            if e > a:
                spans[r] = spans_of(len(texts[r]), first[a:e], count[a:e])
                spans[r] = whole_characters(texts[r], spans[r]) if characters else spans[r]
        types = out_types(table)
        data = [table["doc_id"].cast(pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([[{"start": a, "end": e} for a, e in s] for s in spans], types[2].type), pa.array([cut(t, s) for t, s in zip(texts, spans, strict=True)], pa.binary())]
        return pa.table([*data, *(table[f.name] for f in types[4:])], schema=pa.schema(types))

    def out_types(table: pa.Table) -> list[pa.Field]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return [pa.field("doc_id", pa.int64()), pa.field("n_bytes", pa.int64()), pa.field("spans", span), pa.field("kept", pa.binary()), *(table.schema.field(f"carry_{i}") for i in range(len(carry)))]

    asked = rows.select("block", "doc_id", "text", *[f"carry_{i}" for i in range(len(carry))]).groupBy("block").applyInArrow(lambda t: ask(t, parts), MAIL)
    answers = asked.groupBy("part").applyInArrow(answer, MAIL)
    told = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda t, a: tell(t, a, parts), MAIL)
    settled = told.groupBy("part").applyInArrow(settle, MAIL)
    schema = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary" + "".join(f", carry_{i} {t}" for i, c in enumerate(carry) for t in [dict(docs.dtypes)[c]])
    out = rows.groupBy("block").cogroup(settled.groupBy("block")).applyInArrow(finish, schema)
    return out.select("doc_id", "n_bytes", "spans", "kept", *[F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)])
