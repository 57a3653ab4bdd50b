"""Removal of byte strings that occur more than once, by bucket-pointer refinement."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cartlight.llm.scratch import Scratch

# Bytes of the first buckets; doubled three times they give the length of the strings that are judged.
_FIRST = 25
LENGTH = 8 * _FIRST
# Suffixes start at representatives: of the _SPAN positions where a bucket of 50 bytes can start in a string of LENGTH,
# the one with the smallest pointer.
_BUCKET = 2 * _FIRST
_SPAN = LENGTH - _BUCKET + 1
_BLOCK = 1 << 17
_BYTES = np.random.default_rng(8).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_LOW = np.uint64((1 << 24) - 1)


def _stirred(z: np.ndarray) -> np.ndarray:
    z ^= z >> np.uint64(32)
    z *= np.uint64(0x9E3779B97F4A7C15)
    z ^= z >> np.uint64(29)
    return z


def _refined(pointers: np.ndarray, step: int) -> np.ndarray:
    """Pointer of (own bucket, bucket ``step`` further on)."""
    z = pointers[:-step] * np.uint64(0xD6E8FEB86659FD93)
    z += pointers[step:]
    return _stirred(z)


def _pointers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket pointers of the strings of 50, 100 and 200 bytes at every position where one fits.

    The first buckets hold 25 bytes. Each refinement takes the pair of a suffix's pointer and the pointer found where
    its bucket's bytes end, and so uses the pointers of the refinement before.
    """
    own = _BYTES[data]
    for step, count in ((1, 5), (5, 5)):
        n = len(own) - step * (count - 1)
        z = own[:n].copy()
        for k in range(1, count):
            z *= np.uint64(0xA0761D6478BD642F)
            z += own[k * step : k * step + n]
        own = _stirred(z)
    fifty = _refined(own, _FIRST)
    hundred = _refined(fifty, 2 * _FIRST)
    return fifty, hundred, _refined(hundred, 4 * _FIRST)


def _blocks(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first position, text per start, pointers) by blocks of starts; text -1 where no string of LENGTH fits."""
    for at in range(0, len(data) - LENGTH + 1, _BLOCK):
        part = data[at : at + _BLOCK + LENGTH - 1]
        starts = np.arange(at, at + len(part) - LENGTH + 1)
        text = np.searchsorted(ends, starts, side="right")
        text[starts + LENGTH > ends[text]] = -1
        yield (at, text, *_pointers(part))


def _short(pointers: np.ndarray) -> np.ndarray:
    """32 bits of pointers, never 0: enough to tell which buckets may hold several classes."""
    return np.maximum(pointers >> np.uint64(33), np.uint64(1)).astype(np.int32)


def representatives(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, low, high, place, pointer, own, left, right): runs of starts low..high that share a representative.

    ``own`` is the pointer of all bytes of the run's strings; equal strings have equally placed representatives, so
    they belong to runs with the same ``pointer``. ``left`` and ``right`` tell the 100 bytes that end and that begin
    with the representative's bucket, 0 where no string of the run holds them.
    """
    for at, text, fifty, hundred, full in _blocks(data, ends):
        key = (fifty & ~_LOW) | np.arange(len(fifty), dtype=np.uint64)
        width = 1
        while 2 * width <= _SPAN:  # minimum of the next ``width`` keys; of equal ones the leftmost
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        rest = _SPAN - width
        key = np.minimum(key[: len(full)], key[rest : rest + len(full)])
        place = (key & _LOW).astype(np.int64)
        change = np.flatnonzero((np.diff(place) != 0) | (np.diff(text) != 0))
        low = np.r_[0, change + 1]
        high = np.r_[change, len(place) - 1]
        good = text[low] >= 0
        low, high = low[good], high[good]
        size = (high - low).astype(np.uint64)
        own = _stirred(full[low] * np.uint64(0xD6E8FEB86659FD93) + full[high] + size * np.uint64(0xA0761D6478BD642F))
        mid = place[low]
        left = np.where(mid - _BUCKET >= low, _short(hundred[np.maximum(mid - _BUCKET, 0)]), 0)
        right = np.where(mid + 2 * _BUCKET <= high + LENGTH, _short(hundred[np.minimum(mid, len(hundred) - 1)]), 0)
        yield text[low], low + at, high + at, mid + at, fifty[mid], own, left, right


def _stream(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a batch one after the other, and where each ends."""
    texts = [t or b"" for t in column.to_pylist()]
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def repeated_substrings(documents: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_bytes, spans (start and end of each maximal stretch removed) and kept (the other bytes).

    Whole texts are UTF-8 bytes. A byte goes if a string of 200 bytes that covers it starts anywhere else too, in the
    same or another row; strings may overlap, are judged on the input, and never cross documents. One row per row
    of ``documents``. A null text counts as empty; texts under 200 bytes stay whole. Rows repeating doc_id and text
    remove each other's bytes like any copies; a null doc_id is kept.

    Suffixes are sorted into buckets by the pointer of 50 bytes and refined by the pointers of later offsets up to 200.
    Only one representative per run of neighbouring suffixes takes part: the smallest pointer of 50 bytes within the
    200, which equal strings share. Representatives alone in their bucket drop out first. Runs with equal bytes
    then become one class, combined in the map tasks; a class of two or more is repeated as a whole. Where
    several classes of a bucket go on alike to one side, one run per class is refined to its single suffixes. So a string in a third of all
    documents is one row from there on, and no bucket is gathered or paired.
    """
    spark = documents.sparkSession
    scratch = scratch or Scratch(spark, "substring-dedup")
    key = [
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit((1 << 63) - 1)).alias("k0"), F.xxhash64("text").alias("k1")
    ]
    texts = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), *key, F.col("text").cast("binary").alias("text")
    )
    long = texts.filter(F.octet_length("text") >= LENGTH).select("k0", "k1", "text")

    def represent(batches):
        for batch in batches:
            data, ends = _stream(batch.column(2))
            begin = np.r_[0, ends[:-1]] if len(ends) else ends
            for text, low, high, place, pointer, own, left, right in representatives(data, ends):
                take = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(take), batch.column(1).take(take), _signed(pointer), _signed(own),
                        pa.array(low - begin[text]), pa.array((high - low).astype(np.int16)),
                        pa.array((place - low).astype(np.int16)), pa.array(left.astype(np.int32)),
                        pa.array(right.astype(np.int32)),
                    ],
                    ["k0", "k1", "ptr", "own", "low", "more", "place", "left", "right"],
                )

    kind = "k0 bigint, k1 bigint, ptr bigint, own bigint, low bigint, more smallint, place smallint, left int, right int"
    runs = scratch.keep(long.mapInArrow(represent, kind), "runs")
    shared = runs.groupBy("ptr").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("ptr")
    open_runs = scratch.keep(runs.join(shared, "ptr"), "open")
    scratch.drop(runs)
    classes = scratch.keep(
        open_runs.groupBy("ptr", "own").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("k0", "k1", "low", "more", "place")).alias("one"),
            F.min("left").alias("left"), F.min("right").alias("right"),
        ), "classes",
    )
    # A string of 200 holds 50 bytes more than the bucket on its left or on its right. A class is refined only where
    # another one has the same 100 bytes on that side, and only in its starts that reach so far.
    sides = {
        side: classes.filter(F.col(side) != 0).groupBy("ptr", side).agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
        .select("ptr", side, F.lit(True).alias(f"more_{side}")) for side in ("left", "right")
    }
    judged = classes.join(sides["left"], ["ptr", "left"], "left").join(sides["right"], ["ptr", "right"], "left")
    wanted = judged.filter("more_left or more_right").select("one.k0", "one.k1", F.struct(
        "ptr", "own", "one.low", "one.more",
        F.when(F.col("more_left"), 0).otherwise(F.greatest(F.lit(0), F.col("one.place") - (_BUCKET - 1))).alias("first"),
        F.when(F.col("more_right"), F.col("one.more").cast("int")).otherwise(
            F.least(F.col("one.more").cast("int"), F.col("one.place") - (2 * _BUCKET + 1))).alias("last"),
    ).alias("r")).filter("r.first <= r.last")
    wanted = wanted.groupBy("k0", "k1").agg(F.collect_list("r").alias("wanted"))

    def refine(batches):
        for batch in batches:
            for text, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = np.frombuffer(text, np.uint8)
                for k in range(0, len(rows), 2000):
                    some = rows[k : k + 2000]
                    parts = [data[r["low"] + r["first"] : r["low"] + r["last"] + LENGTH] for r in some]
                    ends = np.cumsum([len(p) for p in parts])
                    begin = np.r_[0, ends[:-1]]
                    ptr = np.array([r["ptr"] for r in some])
                    own = np.array([r["own"] for r in some])
                    first = np.array([r["first"] for r in some])
                    for at, part, _, _, full in _blocks(np.concatenate(parts), ends):
                        good = np.flatnonzero(part >= 0)
                        which = part[good]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(ptr[which]), pa.array(own[which]), _signed(full[good]),
                                pa.array((good + at - begin[which] + first[which]).astype(np.int16)),
                            ],
                            ["ptr", "own", "full", "at"],
                        )

    # Rows repeating doc_id and text give their suffixes again, which are repeated then indeed.
    joined = long.join(wanted.hint("merge"), ["k0", "k1"])
    suffixes = scratch.keep(
        joined.select("text", "wanted").mapInArrow(refine, "ptr bigint, own bigint, full bigint, at smallint"), "suffixes"
    )
    twice = suffixes.groupBy("ptr", "full").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("ptr", "full")
    partly = suffixes.join(twice, ["ptr", "full"], "left_semi").groupBy("ptr", "own").agg(
        F.collect_set("at").alias("starts")
    )
    found = classes.join(partly, ["ptr", "own"], "left").filter("n > 1 or starts is not null").select(
        "ptr", "own", F.when(F.col("n") == 1, F.sort_array("starts")).alias("starts")
    )
    found = scratch.keep(found, "repeated")
    scratch.drop(suffixes, classes)
    place = open_runs.join(found, ["ptr", "own"]).select(
        "k0", "k1", F.struct("low", "more", "starts").alias("r")
    ).distinct()
    cuts = scratch.keep(place.groupBy("k0", "k1").agg(F.collect_list("r").alias("cuts")), "cuts")
    scratch.drop(open_runs, found)

    def cut(batches):
        for batch in batches:
            sizes, spans, kept = [], [], []
            for text, rows in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist()):
                text = text or b""
                gone = _stretches(rows) if rows else []
                at, parts = 0, []
                for start, end in gone:
                    parts.append(text[at:start])
                    at = end
                sizes.append(len(text))
                spans.append([{"start": a, "end": b} for a, b in gone])
                kept.append(b"".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(sizes, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array(kept, pa.binary()),
                ],
                ["doc_id", "n_bytes", "spans", "kept"],
            )

    return texts.join(cuts.hint("merge"), ["k0", "k1"], "left").select("doc_id", "text", "cuts").mapInArrow(
        cut, "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"
    )


def _stretches(rows: list[dict]) -> list[tuple[int, int]]:
    """The bytes covered by the repeated strings of all runs, as merged (start, end)."""
    pieces = []
    for row in rows:
        if row["starts"] is None:
            pieces.append((row["low"], row["low"] + row["more"] + LENGTH))
        else:
            pieces += [(row["low"] + at, row["low"] + at + LENGTH) for at in row["starts"]]
    merged: list[list[int]] = []
    for start, end in sorted(pieces):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return [(a, b) for a, b in merged]
