"""Best-fit packing of token pieces by linear grouping."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cartlight.llm.scratch import Scratch
from cartlight.llm.tokens import as_bytes, worker_encoder

# Groups of equal cardinality that the large lengths are rounded up in, and the shares of the capacity up to which a
# length may count as small; the share whose plan needs the fewest sequences is taken.
GROUPS, SMALL = 1000, (1 / 8, 1 / 4, 1 / 3)
# Items ranked within one task; a length with more is ranked in several parts.
_RANKED = 100_000
# Words whose ids a worker remembers: they take some 20 MB beside what other stages hold.
_REMEMBERED = 1 << 16


def token_pieces(documents: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: doc_id, piece, start, length, ids (little-endian unsigned 32-bit).

    A document's ids are those of the library for its whole text, then ``end_id``. A null text counts as empty and so
    gives one piece with ``end_id`` alone. Rows repeating a doc_id each give their pieces.
    """
    with open(tokenizer, encoding="utf-8") as file:
        spec = documents.sparkSession.sparkContext.broadcast(file.read())
    width, end = 4 * capacity, as_bytes([end_id])

    def cut(batches):
        encoder = worker_encoder(spec.value, as_bytes, _REMEMBERED)
        for batch in batches:
            out: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids": []}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encoder.id_bytes(text or "") + end
                for k in range(0, len(ids), width):
                    part = ids[k : k + width]
                    for name, value in zip(out, (doc_id, k // width, k // 4, len(part) // 4, part)):
                        out[name].append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_pydict({n: pa.array(v, t) for (n, v), t in zip(out.items(), kinds)})

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        cut, "doc_id bigint, piece int, start bigint, length bigint, ids binary"
    )


def _fullest(room: int, sizes: list[int]) -> list[int]:
    """Positions of sizes (decreasing) whose sum comes closest to ``room`` from below; of these, fewest and largest.

    Bit s of a number says whether the sum s can be reached by so many items.
    """
    mask, layers = (1 << (room + 1)) - 1, [1]
    best, depth = 0, 0
    usable = [s for s in sizes if s <= room]
    while usable and best < room:
        reached, last = 0, layers[-1]
        for size in usable:
            reached |= last << size
        reached &= mask
        if not reached:
            break
        layers.append(reached)
        if reached.bit_length() - 1 > best:
            best, depth = reached.bit_length() - 1, len(layers) - 1
    taken, place = [], {size: k for k, size in enumerate(sizes)}
    for layer in reversed(layers[:depth]):
        size = next(s for s in usable if s <= best and layer >> (best - s) & 1)
        taken.append(place[size])
        best -= size
    return taken


def _configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """(position of the size of each place, number of such sequences) until no item is left.

    The longest size left is completed by the fullest set of others, as often as there are items for it, so each
    configuration uses up a size.
    """
    found, demand = [], list(demand)
    while any(demand):
        left = [k for k, n in enumerate(demand) if n]
        first = left[0]
        pattern = [first] + [left[k] for k in _fullest(capacity - sizes[first], [sizes[k] for k in left])]
        pattern = [k for i, k in enumerate(pattern) if pattern[:i].count(k) < demand[k]]
        times = min(demand[k] // pattern.count(k) for k in pattern)
        for k in pattern:
            demand[k] -= times
        found.append((pattern, times))
    return found


def _take(segments: list[list[int]], n: int) -> list[tuple[int, int, int]]:
    """The next n items of a group, as (length, first rank, count)."""
    taken = []
    while n and segments:
        length, first, have = segments[0]
        use = min(n, have)
        taken.append((length, first, use))
        n -= use
        if use == have:
            segments.pop(0)
        else:
            segments[0] = [length, first + use, have - use]
    return taken


def plan_packing(counts: dict[int, int], capacity: int) -> np.ndarray:
    """The plan with the fewest sequences of those that ``_plan`` makes with the shares in SMALL."""
    plans = [_plan(counts, capacity, small) for small in SMALL]
    return min(plans, key=lambda plan: plan[0])[1]


def _plan(counts: dict[int, int], capacity: int, small: float) -> tuple[int, np.ndarray]:
    """Number of sequences, and runs (length, first rank, count, first sequence, items a sequence, offset) that place every item.

    Works on the counts per length alone, at most ``capacity`` of them. The items of a run go to consecutive
    sequences, ``items a sequence`` to each, from ``offset`` on.

    Large lengths are put in decreasing order into groups of equal cardinality and rounded up to the longest of their
    group; the few sizes are packed by configurations, each the fullest for the longest size left; the places then take
    the real items, and what they leave free is known. The small items, in decreasing order, each go where they fit
    most tightly.
    """
    runs: list[tuple[int, int, int, int, int, int]] = []
    opened: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    sequences = 0

    def leave(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in opened:
                opened[room] = []
                insort(rooms, room)
            opened[room].append((first, n))

    large = [(length, counts[length]) for length in sorted(counts, reverse=True) if length > capacity * small]
    total = sum(n for _, n in large)
    order = [[length, 0, n] for length, n in large]
    groups = []
    for k in range(GROUPS):
        group = _take(order, total * (k + 1) // GROUPS - total * k // GROUPS)
        if group:
            groups.append([list(s) for s in group])
    merged: dict[int, list[list[int]]] = {}
    for group in groups:  # groups that round to the same size are one
        merged.setdefault(group[0][0], []).extend(group)
    sizes = list(merged)
    for pattern, times in _configurations(sizes, [sum(s[2] for s in merged[k]) for k in sizes], capacity):
        slots = [_take(merged[sizes[k]], times) for k in pattern]
        done = 0
        while done < times:  # pieces in which every slot holds items of one length
            step = min([s[0][2] for s in slots if s], default=0)
            if not step:
                break
            offset = 0
            for slot in slots:
                if slot:
                    length, first, have = slot[0]
                    runs.append((length, first, step, sequences + done, 1, offset))
                    offset += length
                    slot[0] = (length, first + step, have - step)
                    if have == step:
                        slot.pop(0)
            leave(capacity - offset, sequences + done, step)
            done += step
        sequences += done

    rest = [s for group in merged.values() for s in group]
    rest += [[length, 0, n] for length, n in counts.items() if length <= capacity * small]
    for length, first, n in sorted(rest, reverse=True):
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                need = -(-n // (capacity // length))
                leave(capacity, sequences, need)
                sequences += need
                continue
            room = rooms[at]
            start, have = opened[room].pop()
            if not opened[room]:
                del opened[room], rooms[at]
            each = room // length
            whole = min(have, n // each)
            if whole:
                runs.append((length, first, whole * each, start, each, capacity - room))
                leave(room - each * length, start, whole)
            else:  # one sequence takes what is left
                whole, each = 1, n
                runs.append((length, first, n, start, n, capacity - room))
                leave(room - n * length, start, 1)
            first, n = first + whole * each, n - whole * each
            leave(room, start + whole, have - whole)
    return sequences, np.array(runs, np.int64).reshape(-1, 6)


def best_fit_pack(items: DataFrame, capacity: int = 2048, scratch: Scratch | None = None) -> DataFrame:
    """``items`` (length from 1 to ``capacity``, any other columns) with sequence_id and offset.

    Every sequence holds at most ``capacity`` and is filled without gaps from 0. Only the counts per length come to
    the driver, and the plan made of them, whose size depends on ``capacity`` alone, goes to the tasks. An item's
    rank within its length picks its place; a length with very many items is ranked in parts whose starts are added.
    Lengths that are null or outside the range raise. Equal rows are ranked arbitrarily, which changes no result.
    """
    scratch = scratch or Scratch(items.sparkSession, "packing")
    spark = items.sparkSession
    clash = {"sequence_id", "offset", "_part", "_rank", "_start", "_n"} & set(items.columns)
    if clash:
        raise ValueError(f"rename the columns {sorted(clash)}")
    rows = scratch.keep(items, "items")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(length is None or not 0 < length <= capacity for length in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    runs = plan_packing(counts, capacity)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    shared = spark.sparkContext.broadcast(runs)

    parts = spark.createDataFrame(
        [(length, -(-n // _RANKED)) for length, n in counts.items()], "length bigint, _parts bigint"
    )
    names = [f"`{c}`" for c in items.columns]
    split = rows.join(F.broadcast(parts), "length").withColumn(
        "_part", F.pmod(F.xxhash64(*names), F.col("_parts"))
    ).drop("_parts")
    starts = split.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.withColumn(
        "_start", F.sum("_n").over(Window.partitionBy("length").orderBy("_part")) - F.col("_n")
    ).drop("_n")
    rank = F.row_number().over(Window.partitionBy("length", "_part").orderBy(*names)).cast("bigint") - 1
    ranked = split.withColumn("_rank", rank).join(starts, ["length", "_part"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_start")).select(*names, "_rank")

    def place(batches):
        table = shared.value
        keys = (table[:, 0] << 40) + table[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False).astype(np.int64)
            run = table[np.searchsorted(keys, (length << 40) + rank, side="right") - 1]
            k, each = rank - run[:, 1], run[:, 4]
            data = {n: batch.column(n) for n in batch.schema.names if n != "_rank"}
            data["sequence_id"] = pa.array(run[:, 3] + k // each)
            data["offset"] = pa.array(run[:, 5] + k % each * length)
            yield pa.RecordBatch.from_pydict(data)

    fields = ", ".join(f"`{n}` {t}" for n, t in items.dtypes)
    return ranked.mapInArrow(place, f"{fields}, sequence_id bigint, offset bigint")
