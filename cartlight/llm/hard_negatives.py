"""Hard negatives of anchors by a secondary sort of pair scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from cartlight.functions.ranking import dense_index, top_k_per
from cartlight.llm.scratch import Scratch

# Rows of a block of vectors and its size, anchors that are scored together, parts that the blocks are dealt into for
# each such group of anchors, and scores held at once. None of them changes a result.
_BLOCK, _BLOCK_BYTES, _ANCHORS, _PARTS, _AT_ONCE = 4096, 1 << 18, 1024, 16, 1 << 20
# Scores are smaller in size (see ``hard_negatives``), so as a score it stands for "none".
_LIMIT = 1 << 62
_NONE = -_LIMIT

_PACKED = pa.schema([
    ("grp", pa.int64()), ("part", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("rows", pa.binary()),
    ("labels", pa.binary()), ("vectors", pa.binary()), ("windows", pa.binary()),
])
_PACKED_SQL = "grp bigint, part int, n int, ids binary, rows binary, labels binary, vectors binary, windows binary"
_PAIRS_SQL = "place bigint, score bigint, vec_id bigint, row bigint"
_MINED = pa.schema([
    ("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("rank", pa.int32()), ("negative_id", pa.int64()),
    ("positive_score", pa.int64()), ("negative_score", pa.int64()),
])
_MINED_SQL = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def _packing(windows: int, low: int, high: int) -> Callable:
    """A task that turns consecutive rows of one ``grp`` into blocks of matrices, shorter vectors filled up with zeros.

    The scores of an anchor's positives become ``windows`` pairs (least, greatest) of a negative's score.
    """

    def limits(scores: list[int]) -> list[int]:
        pairs = [(-(-low * s // 100), high * s // 100) for s in scores] + [(1, 0)] * (windows - len(scores))
        return [bound for pair in pairs for bound in pair]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, key, size = TaskContext.get().partitionId(), 0, None, 0
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            vectors = np.zeros((len(held), max(len(h[3]) for h in held)), np.int32)
            for k, h in enumerate(held):
                vectors[k, : len(h[3])] = h[3]
            columns = [np.array([h[c] for h in held], np.int64).tobytes() for c in (0, 1, 2, 4)]
            values = [key, (task + made) % _PARTS, len(held), *columns[:3], vectors.tobytes(), columns[3]]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _PACKED)], schema=_PACKED)

        for batch in batches:
            for grp, vec_id, row, label, vector, scores in zip(*[c.to_pylist() for c in batch.columns]):
                if held and (grp != key or len(held) == _BLOCK or size > _BLOCK_BYTES):
                    yield block()
                    made, held, size = made + 1, [], 0
                key, size = grp, size + 4 * len(vector) + 24
                held.append((vec_id, row, label, vector, limits(scores)))
        if held:
            yield block()

    return run


class _Block:
    """Packed rows: vectors by vec_id, or anchors, whose ``ids`` are their places."""

    def __init__(self, n: int, ids: bytes, rows: bytes, labels: bytes, vectors: bytes, windows: bytes, by_id: bool):
        self.ids, self.rows, self.labels = (np.frombuffer(x, np.int64) for x in (ids, rows, labels))
        self.vectors = np.frombuffer(vectors, np.int32).reshape(n, -1)
        self.windows = np.frombuffer(windows, np.int64).reshape(n, -1)
        if by_id:
            order = np.lexsort((self.rows, self.ids))
            self.ids, self.rows, self.labels, self.vectors = (
                x[order] for x in (self.ids, self.rows, self.labels, self.vectors))
        self.longest = float((self.vectors.astype(float) ** 2).sum(axis=1).max())

    def scores(self, other: _Block, some: slice) -> np.ndarray:
        """Inner products of some rows with all of ``other``: as doubles where these are exact, else as integers."""
        kind = np.float64 if self.longest * other.longest < 2.0**104 else np.int64
        width = min(self.vectors.shape[1], other.vectors.shape[1])
        return self.vectors[some, :width].astype(kind) @ other.vectors[:, :width].astype(kind).T


def _joined(blocks: list[_Block]) -> _Block:
    """The blocks of a group of anchors as one."""
    one, width = blocks[0], max(b.vectors.shape[1] for b in blocks)
    one.vectors = np.concatenate([np.pad(b.vectors, ((0, 0), (0, width - b.vectors.shape[1]))) for b in blocks])
    for name in ("ids", "rows", "labels", "windows"):
        setattr(one, name, np.concatenate([getattr(b, name) for b in blocks]))
    one.longest = max(b.longest for b in blocks)
    return one


class _Best:
    """The k best (score, id, row) of every list so far."""

    def __init__(self, lists: int, k: int):
        self.scores, self.ids, self.rows = (np.full((lists, k), fill, np.int64) for fill in (_NONE, 0, 0))

    def offer(self, lists: np.ndarray, scores: np.ndarray, block: _Block) -> None:
        """Merge a row of scores over the block's rows into each of ``lists``; the scores are used up."""
        every, k = np.arange(len(scores)), self.scores.shape[1]
        found = []
        for _ in range(min(k, scores.shape[1])):
            at = scores.argmax(axis=1)  # the first of equals has the smallest id
            found.append((scores[every, at].astype(np.int64), block.ids[at], block.rows[at]))
            scores[every, at] = _NONE
            if (found[-1][0] == _NONE).all():
                break
        old = (self.scores, self.ids, self.rows)
        new = [np.concatenate([o[lists], np.stack(f, axis=1)], axis=1) for o, f in zip(old, zip(*found))]
        order = np.lexsort((new[2], new[1], -new[0]), axis=1)[:, :k]
        for o, n in zip(old, new):
            o[lists] = np.take_along_axis(n, order, axis=1)

    def pairs(self, places: np.ndarray) -> pa.RecordBatch:
        """(place, score, vec_id, row) once each; every anchor has equally many lists."""
        hit = self.scores != _NONE
        place = np.broadcast_to(places.repeat(len(hit) // len(places))[:, None], hit.shape)
        rows = np.stack([x[hit] for x in (place, self.scores, self.ids, self.rows)], axis=1)
        rows = np.unique(rows, axis=0) if len(rows) else rows
        return pa.RecordBatch.from_arrays([pa.array(rows[:, c]) for c in range(4)], ["place", "score", "vec_id", "row"])


def _searching(counted: Callable, lists: int, k: int) -> Callable:
    """A task over blocks by (grp, part, kind): the anchors of a group, then the vectors dealt to a part.

    ``counted(scores, anchors, some, block)`` yields, for each of an anchor's lists, the scores with those that do not
    count made ``_NONE``. Held are the anchors of one group, one block, and the best so far.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, heads, anchors, best = None, [], None, None
        for batch in batches:
            for row in batch.to_pylist():
                if (row["grp"], row["part"]) != key:
                    if best is not None:
                        yield best.pairs(anchors.ids)
                    key, heads, anchors, best = (row["grp"], row["part"]), [], None, None
                block = _Block(*[row[f] for f in _PACKED.names[2:]], by_id=row["kind"] == 1)
                if row["kind"] == 0:
                    heads.append(block)
                    continue
                if not heads:  # a group whose anchors ask for nothing
                    continue
                if best is None:
                    anchors = _joined(heads)
                    best = _Best(lists * len(anchors.ids), k)
                step = max(1, _AT_ONCE // len(block.ids))
                for start in range(0, len(anchors.ids), step):
                    some = slice(start, min(start + step, len(anchors.ids)))
                    scores = anchors.scores(block, some)
                    for w, ranked in enumerate(counted(scores, anchors, some, block)):
                        best.offer(np.arange(some.start, some.stop) * lists + w, ranked, block)
        if best is not None:
            yield best.pairs(anchors.ids)

    return run


def _same_label(scores, anchors, some, block):
    count = (anchors.labels[some, None] == block.labels) & (anchors.rows[some, None] != block.rows)
    yield np.where(count, scores, scores.dtype.type(_NONE))


def _in_windows(scores, anchors, some, block):
    other = anchors.labels[some, None] != block.labels
    for w in range(0, anchors.windows.shape[1], 2):
        low, high = anchors.windows[some, w, None], anchors.windows[some, w + 1, None]
        yield np.where(other & (scores >= low) & (scores <= high), scores, scores.dtype.type(_NONE))


def _mining(negatives: int, low: int, high: int) -> Callable:
    """A task over pairs by (anchor, descending score, kind, id): positives open windows, negatives fill them.

    Of an anchor only its open windows are held. A window opens before its negatives come: their scores are at most
    the positive's, and of equal ones the positive comes first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, windows = None, []
        for batch in batches:
            out = []
            for place, score, kind, vec_id, anchor_id in zip(*[c.to_pylist() for c in batch.columns]):
                if place != at:
                    at, windows = place, []
                if kind == 0:
                    windows.append([vec_id, score, 0])
                    continue
                for window in windows:
                    if window[2] < negatives and low * window[1] <= 100 * score <= high * window[1]:
                        window[2] += 1
                        out.append((anchor_id, window[0], window[2], vec_id, window[1], score))
            columns = [pa.array([o[c] for o in out], f.type) for c, f in enumerate(_MINED)]
            yield pa.RecordBatch.from_arrays(columns, schema=_MINED)

    return run


def whole_numbers(vectors: DataFrame, anchor: Column, scale: int) -> DataFrame:
    """vec_id, label, v (floor of scale * component), anchor, of the rows that take part (see ``hard_negatives``)."""
    rows = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"),
        F.col("embedding").cast("array<double>").alias("x"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
    ).filter("vec_id is not null and label is not null and x is not null").filter(
        F.forall("x", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    )
    floored = F.transform("x", lambda c: F.floor(c * scale).cast("double"))
    rows = rows.filter(F.aggregate(floored, F.lit(0.0), lambda s, c: s + c * c) < float(_LIMIT))
    return rows.select("vec_id", "label", "anchor", F.transform(floored, lambda c: c.cast("int")).alias("v"))


def hard_negatives(
    vectors: DataFrame, anchor: Column, scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors``: vec_id, label, embedding; ``anchor`` says which rows are anchors. The score of a row is the inner
    product with the anchor of components floor(scale * x); the higher comes first, of equal ones the smaller
    vec_id. An anchor's positives are its first ``positives`` other rows of the same label; of each, the first
    ``negatives`` rows of other labels with low * positive <= 100 * negative <= high * positive are returned
    (0 <= low <= high <= 100), numbered from 1.

    Rows with a null vec_id, label or vector or a null, infinite or NaN component take no part, nor do vectors whose
    squares add up to 2^62 or more, whose scores would not fit a long (Cauchy-Schwarz). A missing component of a
    shorter vector counts as 0. Rows repeating a vec_id are rows of their own, also as anchors. Tables without rows,
    anchors, positives or negatives give no rows. Other columns are ignored.

    Anchors are searched against all rows in blocks: each group of anchors meets the vectors in a fixed number of
    parts, and a part hands on an anchor's best alone, first the positives, then, their scores known, the
    negatives of their windows. These pairs are dealt by anchor and sorted by (anchor, descending score, id)
    within the partitions; one pass over the sorted stream opens windows and emits negatives.
    """
    scratch = Scratch(vectors.sparkSession, "hard-negatives")
    spark = vectors.sparkSession
    rows = scratch.keep(whole_numbers(vectors, anchor, scale).withColumn("row", F.monotonically_increasing_id()), "rows")
    fields = ["vec_id", "row", "label", "v"]
    nothing = F.array().cast("array<bigint>").alias("scores")
    blocks = scratch.keep(
        rows.select(F.lit(0).cast("bigint").alias("grp"), *fields, nothing).mapInArrow(_packing(0, low, high), _PACKED_SQL), "blocks")
    heads = scratch.keep(dense_index(rows.filter("anchor").select(*fields), "place").withColumn(
        "grp", F.floor(F.col("place") / _ANCHORS)), "anchors")
    groups = (heads.agg(F.max("grp")).first()[0] or 0) + 1
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def search(anchors: DataFrame, windows: int, counted: Callable, k: int) -> DataFrame:
        """The pairs (place, score, vec_id, row) that the parts hand on."""
        packed = anchors.repartition("grp").sortWithinPartitions("grp", "place").select("grp", F.col("place").alias("vec_id"), *fields[1:], "scores").mapInArrow(
            _packing(windows, low, high), _PACKED_SQL)
        asked = packed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1)))).withColumn("kind", F.lit(0))
        shown = blocks.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<bigint>"))).withColumn(
            "kind", F.lit(1))
        met = asked.unionByName(shown).repartition(parts, "grp", "part").sortWithinPartitions("grp", "part", "kind")
        return met.mapInArrow(_searching(counted, max(windows, 1), k), _PAIRS_SQL)

    order = [F.desc("score"), F.asc("vec_id"), F.asc("row")]
    near = search(heads.select("grp", "place", *fields, nothing), 0, _same_label, positives)
    near = scratch.keep(top_k_per(near, "place", positives, order).drop("rank"), "positives")
    opened = near.groupBy("place").agg(F.collect_list("score").alias("scores"))  # at most ``positives`` each
    asking = heads.join(opened, "place").select("grp", "place", *fields, "scores")
    far = scratch.keep(search(asking, positives, _in_windows, negatives), "negatives")
    pairs = near.withColumn("kind", F.lit(0)).unionByName(far.withColumn("kind", F.lit(1)))
    named = pairs.join(heads.select("place", F.col("vec_id").alias("anchor_id")), "place")
    return named.repartition(parts, "place").sortWithinPartitions("place", F.desc("score"), "kind", "vec_id", "row").select(
        "place", "score", "kind", "vec_id", "anchor_id").mapInArrow(_mining(negatives, low, high), _MINED_SQL)
