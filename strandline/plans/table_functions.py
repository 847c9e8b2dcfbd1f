"""Table functions for SQL: the registry's methods over a table argument that is partitioned by sequence and ordered by position.

    SELECT * FROM segment(TABLE(units) PARTITION BY (seq_id) ORDER BY (pos), 'divisive', 5)
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from . import registry


class Segment:
    """(seq_id, method, boundary) of each sequence. Units have seq_id, pos and vec, or vec1 and vec2 of two models, and may have tokens; methods are given by name, several with commas
    between them. The number of segments is the argument `k` or, where that is null, the units' column k. A null method or an unknown name is an error; units of null vectors are too."""

    def __init__(self):
        self.rows: list[Row] = []

    def eval(self, unit: Row, methods: str, k: int | None = None):
        self.methods, self.k = methods, k
        self.rows.append(unit)

    def terminate(self):
        if not self.rows:
            return
        first = self.rows[0].asDict()
        one, two = ("vec1", "vec2") if "vec1" in first else ("vec", "vec")
        k = self.k if self.k is not None else int(first["k"])
        tokens = [list(r["tokens"] or []) for r in self.rows] if "tokens" in first else None
        x = registry.Input(*(np.array([r[c] for r in self.rows], float) for c in (one, two)), k, tokens=tokens)
        for name in self.methods.split(","):
            for b in registry.run(x, registry.parse(name.strip())):
                yield first["seq_id"], name.strip(), int(b)


def register(spark: SparkSession, name: str = "segment") -> None:
    """Make the methods callable from the session's SQL."""
    spark.udtf.register(name, udtf(Segment, returnType="seq_id bigint, method string, boundary int"))
