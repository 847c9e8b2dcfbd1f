"""Writers of results, predictions, trees and the three-table release, and renderers of small report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a rendered report may have; reports are over methods, of which there are few.
MOST_ROWS = 10_000


def results_json(cube: DataFrame, path: str) -> None:
    """One JSON line a method: {method, results: {sequence: {metric: value}}, summary: {metric: mean}}."""
    one = cube.groupBy("method", "seq_id").agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("m"))
    by = one.groupBy("method").agg(F.map_from_entries(F.collect_list(F.struct(F.col("seq_id").cast("string"), "m"))).alias("results"))
    mean = cube.groupBy("method", "metric").agg(F.round(F.avg("value"), 4).alias("v")).groupBy("method").agg(F.map_from_entries(F.collect_list(F.struct("metric", "v"))).alias("summary"))
    by.join(mean, "method").write.mode("overwrite").json(path)


def predictions_json(boundaries: DataFrame, path: str) -> None:
    """A folder for each sequence with its methods' boundaries."""
    boundaries.groupBy("seq_id", "method").agg(F.array_sort(F.collect_list("boundary")).alias("boundaries")).write.mode("overwrite").partitionBy("seq_id").json(path)


def tree_json(levels: DataFrame, path: str) -> None:
    """(seq_id, boundary, level) as one nested row a sequence."""
    of = lambda level: F.array_sort(F.collect_list(F.when(F.col("level") == level, F.col("boundary"))))
    levels.groupBy("seq_id").agg(of("chapter").alias("chapters"), F.array_sort(F.collect_list("boundary")).alias("subtopics")).write.mode("overwrite").json(path)


def load_tree(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, boundary, level) as tree_json wrote it: chapters, and subtopics that are no chapters."""
    rows = spark.read.schema("seq_id long, chapters array<int>, subtopics array<int>").json(path)
    level = F.when(F.array_contains("chapters", F.col("boundary")), "chapter").otherwise("subtopic").alias("level")
    return rows.select("seq_id", "chapters", F.explode("subtopics").alias("boundary")).select("seq_id", "boundary", level)


def load_features(spark: SparkSession, path: str, *modalities: str) -> DataFrame:
    """(seq_id, pos, vec, modality) as features_parquet wrote it; only the folders of the asked modalities are read."""
    rows = spark.read.parquet(path)
    return rows.where(F.col("modality").isin(*modalities)) if modalities else rows


def features_parquet(features: DataFrame, path: str) -> None:
    """(seq_id, pos, modality, vec), a folder for each modality so that readers prune."""
    features.write.mode("overwrite").partitionBy("modality").parquet(path)


def release(metadata: DataFrame, boundaries: DataFrame, sentences: DataFrame, path: str) -> None:
    """Three flat tables: metadata, boundaries, sentences."""
    for name, df in (("metadata", metadata), ("boundaries", boundaries), ("sentences", sentences)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def summary_csv(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def manifest_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def bounded(rows: DataFrame) -> list:
    got = rows.limit(MOST_ROWS + 1).collect()
    if len(got) > MOST_ROWS:
        raise ValueError(f"a report of over {MOST_ROWS} rows is not rendered")
    return got


def latex_table(rows: DataFrame, name: str, columns: dict[str, bool], group: str | None = None) -> str:
    """A LaTeX tabular; `columns` says of each metric whether lower is better, and its best value is bold. A change of `group` draws a rule."""
    got = bounded(rows)
    pick = {c: (min if low else max)((r[c] for r in got if r[c] is not None), default=None) for c, low in columns.items()}
    cell = lambda r, c: "--" if r[c] is None else f"\\textbf{{{r[c]:.4f}}}" if r[c] == pick[c] else f"{r[c]:.4f}"
    out, last = ["\\begin{tabular}{l" + "r" * len(columns) + "}", "\\toprule", " & ".join([name, *columns]) + " \\\\", "\\midrule"], None
    for r in got:
        if group and last is not None and r[group] != last:
            out.append("\\midrule")
        last = r[group] if group else None
        out.append(" & ".join([str(r[name]).replace("_", "\\_"), *(cell(r, c) for c in columns)]) + " \\\\")
    return "\n".join([*out, "\\bottomrule", "\\end{tabular}"])


def markdown_report(rows: DataFrame, name: str, baseline: str, metrics: dict[str, bool]) -> str:
    """A Markdown table with the change against a baseline row in percent and an arrow up for better."""
    got = bounded(rows)
    base = next((r for r in got if r[name] == baseline), None)
    out = ["| " + " | ".join([name, *metrics]) + " |", "|" + "---|" * (len(metrics) + 1)]
    for r in got:
        cells = [str(r[name])]
        for m, low in metrics.items():
            text = f"{r[m]:.4f}"
            if base is not None and base[m] and r[name] != baseline:
                gain = 100 * (base[m] - r[m]) / base[m] * (1 if low else -1)
                text += f" ({'▲' if gain > 0 else '▼' if gain < 0 else '='} {abs(gain):.1f}%)"
            cells.append(text)
        out.append("| " + " | ".join(cells) + " |")
    return "\n".join(out)


def chapter_text(chapters: DataFrame) -> DataFrame:
    """(seq_id, text): one line of stamp and title for each chapter (seq_id, start, title)."""
    from ..functions.scalars import stamp_of

    line = F.concat(stamp_of(F.col("start")), F.lit(" "), F.col("title"))
    return chapters.groupBy("seq_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
