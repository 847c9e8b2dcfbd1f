"""URL filter over a sorted digest array.

Rules (host, path, verdict) become one array of sorted 64-bit XXH64 keys and, beside it, the full rule strings. Both are files that
Spark ships to every executor, where they are memory-mapped. A url's probes (each host suffix on a label border, joined with each
prefix of its path that has the length of some rule's path) are hashed and looked up by one vectorised binary search for a whole
batch; a hit counts only if the stored full string equals the probe, so collisions of digests never matter.

Defined results: null or no `://` gives an empty host and path and no rule; equal rules of two verdicts: the block stands.
"""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch

#: The index is shipped whole to each executor up to this size; larger rule lists are joined by key instead.
MOST_BYTES, MOST_LENGTHS = 512 << 20, 10_000
SCHEMA = "page_id long, host string, path string, rule string, verdict string"
URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    m = URL.search(url or "")
    return (m[1].translate(LOWER), m[2]) if m else ("", "")


class DigestArray:
    """Sorted keys, offsets and strings in one folder; opened by memory mapping."""

    def __init__(self, folder: str, stem: str = ""):
        at = lambda x: os.path.join(folder, stem + x)
        self.keys = np.memmap(at("keys"), np.uint64, "r") if os.path.getsize(at("keys")) else np.zeros(0, np.uint64)
        self.ends = np.memmap(at("ends"), np.uint64, "r")
        self.text = np.memmap(at("text"), np.uint8, "r") if os.path.getsize(at("text")) else np.zeros(0, np.uint8)
        self.verdicts = np.memmap(at("verdicts"), np.uint8, "r") if os.path.getsize(at("verdicts")) else np.zeros(0, np.uint8)
        self.lengths = np.fromfile(at("lengths"), np.uint32).tolist()

    @staticmethod
    def write(rules: list[tuple[str, str, str]], folder: str, stem: str = "") -> None:
        kept: dict[bytes, int] = {}
        lengths = set()
        for host, path, verdict in rules:
            kept[(host.translate(LOWER) + path).encode()] = max(int(verdict == "block"), kept.get((host.translate(LOWER) + path).encode(), 0))
            lengths.add(len(path))
        rows = sorted((xxhash.xxh64_intdigest(k), k, v) for k, v in kept.items())
        at = lambda x: os.path.join(folder, stem + x)
        np.array([r[0] for r in rows], np.uint64).tofile(at("keys"))
        np.cumsum([0, *(len(r[1]) for r in rows)], dtype=np.uint64).tofile(at("ends"))
        np.frombuffer(b"".join(r[1] for r in rows), np.uint8).tofile(at("text"))
        np.array([r[2] for r in rows], np.uint8).tofile(at("verdicts"))
        np.array(sorted(lengths), np.uint32).tofile(at("lengths"))

    def find(self, probes: list[bytes]) -> np.ndarray:
        """The place of each probe among the rules, or -1."""
        found = np.full(len(probes), -1)
        if not len(self.keys) or not probes:
            return found
        hashed = np.fromiter(map(xxhash.xxh64_intdigest, probes), np.uint64, len(probes))
        at = np.searchsorted(self.keys, hashed)
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == hashed):
            for j in range(int(at[i]), len(self.keys)):  # equal digests of different strings stand side by side
                if self.keys[j] != hashed[i]:
                    break
                if self.text[int(self.ends[j]) : int(self.ends[j + 1])].tobytes() == probes[i]:
                    found[i] = j
                    break
        return found


def probes_of(host: str, path: str, lengths: list[int]) -> list[tuple[int, int, bytes]]:
    """(length of the rule, of its host, its full string) of each rule that could fit."""
    suffixes = [host] if host else []
    at = host.find(".")
    while at >= 0:
        suffixes.append(host[at + 1 :])
        at = host.find(".", at + 1)
    return [(len(s) + n, len(s), (s + path[:n]).encode()) for s in suffixes if s for n in lengths if n <= len(path)]


def judge(index: DigestArray, urls: list[str | None], default: str) -> list[tuple]:
    parts = [split_url(u) for u in urls]
    probes = [probes_of(h, p, index.lengths) for h, p in parts]
    places = index.find([x[2] for row in probes for x in row])
    out, k = [], 0
    for (host, path), row in zip(parts, probes, strict=True):
        best = max(((n, h, int(j)) for (n, h, _), j in zip(row, places[k : k + len(row)], strict=True) if j >= 0), default=None)
        k += len(row)
        rule = None if best is None else index.text[int(index.ends[best[2]]) : int(index.ends[best[2] + 1])].tobytes().decode()
        out.append((host, path, rule, default if best is None else ("allow", "block")[index.verdicts[best[2]]]))
    return out


def ship(spark: SparkSession, rules: list[tuple[str, str, str]]) -> str:
    """Write the index on the driver and have Spark fetch it to each executor, also to those that come later. Returns its stem."""
    stem = "digests-" + hashlib.sha256(repr(sorted(rules)).encode()).hexdigest()[:16] + "-"
    folder = os.path.realpath(tempfile.mkdtemp(prefix="digests-"))
    DigestArray.write(rules, folder, stem)
    names = sorted(os.listdir(folder))
    if (total := sum(os.path.getsize(os.path.join(folder, n)) for n in names)) > MOST_BYTES:
        raise ValueError(f"an index of {total} bytes is over MOST_BYTES; use filter_urls_joined")
    for n in names:
        try:
            there = os.path.exists(SparkFiles.get(n))
        except Exception:  # no folder yet
            there = False
        if not there:
            spark.sparkContext.addFile(os.path.join(folder, n))
    return stem


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of each page; rules are (host, path, allow or block) and the longest that fits wins.

    One narrow pass without a shuffle. Rows repeat as they do in the input; an empty table gives no rows; further columns are ignored."""
    stem = ship(pages.sparkSession, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = DigestArray(SparkFiles.getRootDirectory(), stem)
        for b in batches:
            rows = list(zip(*judge(index, b.column(1).to_pylist(), default), strict=True)) or [[]] * 4
            yield batch(page_id=(b.column(0), pa.int64()), host=(rows[0], pa.string()), path=(rows[1], pa.string()), rule=(rows[2], pa.string()), verdict=(rows[3], pa.string()))

    return pages.select(F.col(page_id).cast("long").alias("k"), F.col(url).cast("string").alias("u")).mapInArrow(run, SCHEMA)


def filter_urls_joined(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """The same for rule tables (host, path, verdict) of any size: probes meet rules in a join on digest and full string, without any list on the
    driver but the distinct lengths of rule paths, up to MOST_LENGTHS of them; with more, each prefix of a path is a probe. A probe's hot host is no hot group:
    probes are made distinct by (host, path) first."""
    low = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    host = F.coalesce(low(F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    kept = rules.select((low(F.col("host"))).alias("rule_host"), F.col("path").alias("rule_path"), "verdict").groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("rule_verdict"))
    kept = kept.withColumn("rule", F.concat("rule_host", "rule_path"))
    lengths = [r[0] for r in kept.select(F.length("rule_path")).distinct().limit(MOST_LENGTHS + 1).collect()]
    labels = F.split("host", r"\.", -1)
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    probe = rows.select("host", "path").distinct().withColumn("tail", F.explode(tails)).where("tail <> ''")
    each = F.array(*[F.lit(n) for n in lengths]).cast("array<int>") if len(lengths) <= MOST_LENGTHS else F.sequence(F.lit(0), F.length("path"))
    probe = probe.withColumn("n", F.explode(each)).where(F.col("n") <= F.length("path"))
    probe = probe.withColumn("rule", F.concat("tail", F.expr("substring(path, 1, n)"))).withColumn("digest", F.xxhash64("rule"))
    best = probe.join(kept.withColumn("digest", F.xxhash64("rule")), ["digest", "rule"]).groupBy("host", "path").agg(F.max_by(F.struct("rule", "rule_verdict"), F.struct(F.length("rule"), F.length("rule_host"))).alias("best"))
    return rows.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))
