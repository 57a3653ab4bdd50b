"""Line dedup by overlapping three-line windows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cartlight.llm.rows import others, restored
from cartlight.llm.scratch import Scratch


def line_dedup(documents: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``documents`` with ``text`` cut, and n_lines, n_removed, n_spans (stretches removed) in a struct ``dedup``.

    A window is three consecutive lines (parted by newline, blank ones too, compared exactly). Of all windows that are
    equal anywhere, the same document included, the first in the order of (doc_id, line) stays; every line that a
    later one covers goes, so the stretches removed are the later windows merged. Each line removed still stands
    somewhere. Texts of fewer than three lines have no window and stay, as do null and empty ones.

    Windows are found by 128-bit hashes. Equal windows meet only as counts and minimums, combined in the map tasks; the
    minimum is written and joined back, and adaptive execution splits a window that a third of all documents share. A document's removed
    positions are bounded by its own lines.

    Rows with equal doc_id and text are one document and get the same result; a null doc_id comes last in the order.
    A column named ``dedup`` of the input is replaced.
    """
    spark = documents.sparkSession
    scratch = scratch or Scratch(spark, "line-dedup")
    key = [
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit((1 << 63) - 1)).alias("_doc"),
        F.xxhash64("text").alias("_text"),
    ]
    lines = F.transform(F.split("text", "\n", -1), lambda line: F.struct(
        F.xxhash64(line).alias("x"), F.xxhash64(F.lit("second"), line).alias("y")
    ))
    hashed = documents.filter("text is not null").select(*key, lines.alias("l")).filter("size(l) >= 3")
    at = F.sequence(F.lit(0), F.size("l") - 3)
    windows = hashed.select("_doc", "_text", F.explode(F.transform(at, lambda k: F.struct(
        k.alias("pos"),
        F.xxhash64(F.col("l")[k]["x"], F.col("l")[k + 1]["x"], F.col("l")[k + 2]["x"]).alias("x"),
        F.xxhash64(F.col("l")[k]["y"], F.col("l")[k + 1]["y"], F.col("l")[k + 2]["y"]).alias("y"),
    ))).alias("w")).select("_doc", "_text", "w.*")
    windows = scratch.keep(windows, "windows")
    first = windows.groupBy("x", "y").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("_doc", "_text", "pos")).alias("first")
    ).filter("n > 1").select("x", "y", "first")
    first = scratch.keep(first, "first")  # written, so that the join with it can be split where many share a window
    later = windows.join(first, ["x", "y"]).filter(F.struct("_doc", "_text", "pos") != F.col("first"))
    cuts = scratch.keep(
        later.select("_doc", "_text", "pos").distinct()
        .groupBy("_doc", "_text").agg(F.sort_array(F.collect_list("pos")).alias("_cuts")), "cuts",
    )
    scratch.drop(windows, first)
    rows = documents.drop("dedup")
    columns = rows.columns
    rows = rows.select(others(rows), "text", *key)
    # Merged, not broadcast where the cuts happen to be few: the work grows evenly with the input.
    rows = rows.join(cuts.hint("merge"), ["_doc", "_text"], "left").select("row", "text", "_cuts")

    def cut(batches):
        for batch in batches:
            texts, told = [], []
            for text, starts in zip(batch.column("text").to_pylist(), batch.column("_cuts").to_pylist()):
                parts = text.split("\n") if text is not None else []
                spans, gone = 0, 0
                if starts:
                    kept, at = [], 0
                    for start in starts:
                        if start >= at:  # a line between two removed stretches stays
                            spans += start > at or at == 0
                            kept += parts[at:start]
                        at = start + 3
                    kept += parts[at:]
                    gone = len(parts) - len(kept)
                    text = "\n".join(kept)
                texts.append(text)
                told.append({"n_lines": len(parts), "n_removed": gone, "n_spans": spans})
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(texts, pa.string()), pa.array(told, pa.struct(
                    [("n_lines", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64())]
                ))], ["row", "text", "dedup"],
            )

    schema = rows.select("row", "text").withColumn(
        "dedup", F.lit(None).cast("struct<n_lines:bigint,n_removed:bigint,n_spans:bigint>")
    ).schema
    done = rows.mapInArrow(cut, schema)
    return restored(done, columns, "dedup")
