"""Token counts by a map-side lookup in two tiers."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from cartlight.llm.scratch import Scratch
from cartlight.llm.tokens import worker_encoder

# Words that a task reports as frequent, that it keeps counts of meanwhile, and that are broadcast: at most
# 50,000 strings of up to 64 characters, whatever the input.
_PER_TASK, _KEPT, _BROADCAST = 4096, 1 << 18, 50_000


def frequent_lengths(documents: DataFrame, spec: str) -> dict[str, int]:
    """Token counts of the most frequent words of all texts.

    Every task counts the pre-tokens of its rows in a table of bounded size and reports its most frequent; only these
    few are added up. What is missed here is merely encoded later, so the bound changes no result.
    """

    def count(batches):
        encoder, counts = worker_encoder(spec, len), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for kind, part in encoder.segments(text or ""):
                    if kind == "words":
                        counts.update(part)
                        if len(counts) > _KEPT:
                            counts = Counter(dict(counts.most_common(_KEPT // 2)))
        top = [(t, n) for t, n in counts.most_common(_PER_TASK) if len(t) <= 64]
        yield pa.RecordBatch.from_pydict({
            "word": pa.array([t for t, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64()),
        })

    told = documents.select("text").mapInArrow(count, "word string, n bigint")
    top = told.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(_BROADCAST)
    names = [row["word"] for row in top.collect()]
    encoder = worker_encoder(spec, len)
    return {name: encoder[name] for name in names}


def token_counts(documents: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every whole text, as the library counts for the file ``tokenizer``.

    One row per row of ``documents``. Special strings inside a text count as the library counts them by default. A
    null or empty text has 0 bytes and 0 tokens; doc_id may be null or repeated. Other columns are ignored.

    First tier: a broadcast table of the token counts of frequent words (what stands between white space, with the
    blank before it: a run of pre-tokens). Second tier: each worker encodes a word that is not in it and remembers the
    count for all its tasks. No word is shuffled, only each task's short report.
    """
    spark = documents.sparkSession
    Scratch(spark, "token-counts")
    with open(tokenizer, encoding="utf-8") as file:
        spec = file.read()
    table = spark.sparkContext.broadcast((spec, frequent_lengths(documents, spec)))

    def count(batches):
        encoder = worker_encoder(table.value[0], len)
        encoder.know(table.value[1])
        for batch in batches:
            texts = batch.column(1)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0),
                "n_bytes": pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()),
                "n_tokens": pa.array([sum(encoder.values(t)) if t else 0 for t in texts.to_pylist()], pa.int64()),
            })

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        count, "doc_id bigint, n_bytes bigint, n_tokens bigint"
    )
