"""Benchmark decontamination by a generalised suffix automaton of the test items' words."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cartlight.llm.rows import others, restored
from cartlight.llm.scratch import Scratch

# A word is a run of a-z, 0-9 and non-ASCII bytes after lower-casing A-Z; all other bytes part words.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_WORD = re.compile(rb"[^ ]+")
# Bytes of test items that one task builds an automaton of, and bytes of automata that are broadcast for one pass over the
# documents. A larger benchmark takes several passes. An item is never parted, however long.
SHARD_BYTES, PASS_BYTES = 1 << 19, 64 << 20
# Transitions that a worker remembers.
_STEPS = 1 << 18


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD_BYTES).split() if text else []


class _Builder:
    """Suffix automaton of the word sequences of a shard's items, while it grows."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]]):
        self.ids: dict[bytes, int] = {}
        self.items = [(name, [self.ids.setdefault(w, len(self.ids)) for w in words]) for name, words in items if words]
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in self.items:
            last = 0
            for word in words:
                last = self._extend(last, word)

    def _extend(self, last: int, word: int) -> int:
        step, link, length = self.step, self.link, self.length
        if word in step[last]:
            found = step[last][word]
            return found if length[found] == length[last] + 1 else self._split(last, word, found)
        new = self._state(length[last] + 1, {})
        at = last
        while at >= 0 and word not in step[at]:
            step[at][word] = new
            at = link[at]
        if at >= 0:
            found = step[at][word]
            link[new] = found if length[found] == length[at] + 1 else self._split(at, word, found)
        return new

    def _state(self, length: int, step: dict[int, int]) -> int:
        self.length.append(length)
        self.step.append(step)
        self.link.append(0)
        return len(self.link) - 1

    def _split(self, at: int, word: int, found: int) -> int:
        copy = self._state(self.length[at] + 1, dict(self.step[found]))
        self.link[copy] = self.link[found]
        self.link[found] = copy
        while at >= 0 and self.step[at].get(word) == found:
            self.step[at][word] = copy
            at = self.link[at]
        return copy


def _grouped(lists: dict[int, list[int]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists by state as one array, and where each state's begins."""
    sizes = np.zeros(n + 1, np.int64)
    for state, values in lists.items():
        sizes[state + 1] = len(values)
    return np.cumsum(sizes), np.array([v for state in sorted(lists) for v in lists[state]], np.int32)


class Automaton:
    """Suffix automaton of a shard's items in flat arrays, read by longest matching length.

    A window is ``window`` consecutive words of an item, or a whole shorter item.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        built = _Builder(items)
        n = len(built.link)
        self.window, self.words = window, b" ".join(built.ids)
        self.names = sorted({name for name, _ in built.items if name is not None})
        number = {name: k for k, name in enumerate(self.names)} | {None: -1}
        self.size = max(len(built.ids), 1)
        steps = [(state * self.size + word, to) for state, out in enumerate(built.step) for word, to in out.items()]
        steps = np.array(sorted(steps), np.int64).reshape(-1, 2)
        self.keys, self.targets = np.ascontiguousarray(steps[:, 0]), steps[:, 1].astype(np.int32)
        self.link, self.length = np.array(built.link, np.int32), np.array(built.length, np.int32)
        # The state that holds the last ``window`` words of a match, and the items that have them.
        by_length = np.argsort(self.length, kind="stable").tolist()
        held = [-1] * n
        for state in by_length:
            if built.length[state] >= window:
                up = built.link[state]
                held[state] = state if built.length[up] < window else held[up]
        named: dict[int, set[int]] = {}
        short: dict[int, list[int]] = {}
        for name, words in built.items:
            state = 0
            for k, word in enumerate(words, 1):
                state = built.step[state][word]
                if k >= window:
                    named.setdefault(held[state], set()).add(number[name])
            if len(words) < window:
                short.setdefault(state, []).append(number[name])
        # Short items end where a match ends: those of the state itself, then those of the next shorter suffix with any.
        upper = [-1] * n
        for state in by_length[1:]:
            up = built.link[state]
            upper[state] = up if up in short else upper[up]
        self.held, self.upper = np.array(held, np.int32), np.array(upper, np.int32)
        self.named = _grouped({state: sorted(v) for state, v in named.items()}, n)
        self.short = _grouped(short, n)
        self.least = min([window, *(len(words) for _, words in built.items)])
        pairs = {a * self.size + b for _, words in built.items for a, b in zip(words, words[1:])}
        self.pairs = np.array(sorted(pairs), np.int64)

    @cached_property
    def ids(self) -> dict[bytes, int]:
        return {w: k for k, w in enumerate(self.words.split())}

    @cached_property
    def _known(self) -> dict[int, int]:
        return {}

    def _step(self, state: int, word: int) -> int:
        """The next state, or -1."""
        key = state * self.size + word
        to = self._known.get(key)
        if to is None:
            at = int(np.searchsorted(self.keys, key))
            to = int(self.targets[at]) if at < len(self.keys) and self.keys[at] == key else -1
            if len(self._known) >= _STEPS:
                self._known.clear()
            self._known[key] = to
        return to

    def _runs(self, codes: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches of words that can hold a window: every two neighbours stand side by side in some item."""
        if self.least > 1:
            one, two = codes[:-1], codes[1:]
            known = np.flatnonzero((one >= 0) & (two >= 0))
            pair = one[known] * self.size + two[known]
            place = np.minimum(np.searchsorted(self.pairs, pair), max(len(self.pairs) - 1, 0))
            at = known[self.pairs[place] == pair] if len(self.pairs) else known[:0]
            extra = 1
        else:
            at, extra = np.flatnonzero(codes >= 0), 0
        if not len(at):
            return
        breaks = np.flatnonzero(np.diff(at) > 1)
        firsts = at[np.r_[0, breaks + 1]]
        lasts = at[np.r_[breaks, len(at) - 1]] + extra
        long = lasts - firsts + 1 >= self.least
        yield from zip(firsts[long].tolist(), lasts[long].tolist())

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged stretches (first, last) of words inside an occurrence of a window, and the names of the items concerned."""
        spans: list[tuple[int, int]] = []
        names: set[int] = set()
        if len(words) < self.least or not len(self.keys):
            return spans, set()
        codes = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, len(words))
        (at_named, named), (at_short, short) = self.named, self.short
        for first, last in self._runs(codes):
            state = have = 0
            for at, word in enumerate(codes[first : last + 1].tolist(), first):
                to = self._step(state, word)
                while state and to < 0:
                    state = int(self.link[state])
                    have = int(self.length[state])
                    to = self._step(state, word)
                if to >= 0:
                    state, have = to, have + 1
                cover = have if have >= self.window else 0
                if cover:
                    held = self.held[state]
                    names.update(named[at_named[held] : at_named[held + 1]].tolist())
                end = state if at_short[state] < at_short[state + 1] else int(self.upper[state])
                while end >= 0:
                    if self.length[end] <= have:
                        names.update(short[at_short[end] : at_short[end + 1]].tolist())
                        cover = max(cover, int(self.length[end]))
                    end = int(self.upper[end])
                if cover:
                    start = at - cover + 1
                    while spans and spans[-1][1] >= start - 1:
                        start = min(start, spans.pop()[0])
                    spans.append((start, at))
        return spans, {self.names[k] for k in names if k >= 0}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("ids", "_known")}


def _automata(scratch: Scratch, benchmark: DataFrame, window: int, shard_bytes: int) -> DataFrame:
    """(shard, automaton, n_bytes): items dealt by their hash, each shard's automaton built in a task and written."""
    items = benchmark.select(
        F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text")).distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = -(-total // shard_bytes) or 1
    dealt = items.filter("text is not null").withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)))

    def build(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(r["item_id"], words_of(r["text"])) for batch in batches for r in batch.to_pylist()]
        made = pickle.dumps(Automaton(sorted(rows, key=repr), window))
        yield pa.RecordBatch.from_pydict({
            "shard": pa.array([key[0].as_py()], pa.int64()), "automaton": pa.array([made], pa.binary()),
            "n_bytes": pa.array([len(made)], pa.int64()),
        })

    made = dealt.groupBy("shard").applyInArrow(build, "shard bigint, automaton binary, n_bytes bigint")
    return scratch.keep(made, "automata")


def _passes(automata: DataFrame, pass_bytes: int) -> list[list[int]]:
    """Shards whose automata are broadcast together, by their measured bytes."""
    groups, room = [], 0
    for row in automata.select("shard", "n_bytes").orderBy("shard").collect():  # a row per shard
        if not groups or row["n_bytes"] > room:
            groups.append([])
            room = pass_bytes
        groups[-1].append(row["shard"])
        room -= row["n_bytes"]
    return groups or [[]]


def _searched(
    documents: DataFrame, benchmark: DataFrame, window: int, shard_bytes: int, pass_bytes: int, max_coverage: float | None = None
) -> DataFrame:
    """row (struct of the other columns), text (bytes), n_words, spans, items; with ``max_coverage``, row and text cut."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "decontaminate")
    marked = documents.select(
        others(documents), F.col("text").cast("binary").alias("text"), F.lit(0).cast("bigint").alias("n_words"),
        F.array().cast("array<struct<first:bigint,last:bigint>>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    automata = _automata(scratch, benchmark, window, shard_bytes)
    passes = _passes(automata, pass_bytes)
    for k, shards in enumerate(passes):
        rows = automata.filter(F.col("shard").isin(shards)).select("automaton").collect() if shards else []
        shared = spark.sparkContext.broadcast([pickle.loads(r["automaton"]) for r in rows])
        cuts = max_coverage is not None and k == len(passes) - 1

        def search(batches, shared=shared, cuts=cuts):
            for batch in batches:
                n_words, spans, items, texts, stays = [], [], [], [], []
                before = zip(*(batch.column(n).to_pylist() for n in ("text", "spans", "items")))
                for text, old_spans, old_items in before:
                    words = words_of(text)
                    found, names = [(s["first"], s["last"]) for s in old_spans], set(old_items)
                    for automaton in shared.value:
                        new, more = automaton.hits(words)
                        found += new
                        names |= more
                    merged: list[list[int]] = []
                    for first, last in sorted(found):
                        if merged and first <= merged[-1][1] + 1:
                            merged[-1][1] = max(last, merged[-1][1])
                        else:
                            merged.append([first, last])
                    if cuts:
                        hit = sum(b - a + 1 for a, b in merged)
                        stays.append(not merged or hit <= max_coverage * len(words))
                        texts.append(_without(text, merged) if merged and stays[-1] else text)
                        continue
                    n_words.append(len(words))
                    spans.append([{"first": a, "last": b} for a, b in merged])
                    items.append(sorted(names))
                if cuts:
                    made = pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.binary())], ["row", "text"])
                    yield made.filter(pa.array(stays, pa.bool_()))
                    continue
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row"), batch.column("text"), pa.array(n_words, pa.int64()),
                        pa.array(spans, batch.column("spans").type), pa.array(items, pa.list_(pa.string())),
                    ],
                    ["row", "text", "n_words", "spans", "items"],
                )

        marked = marked.mapInArrow(search, marked.select("row", "text").schema if cuts else marked.schema)
        if k + 1 < len(passes):
            marked = scratch.keep(marked, "searched")
    scratch.drop(automata)
    return marked


def _without(text: bytes, spans: list[list[int]]) -> bytes:
    """The text without the bytes from the first to the last word of each stretch."""
    places = [m.span() for m in _WORD.finditer(text.translate(_WORD_BYTES))]
    parts, at = [], 0
    for first, last in spans:
        parts.append(text[at : places[first][0]])
        at = places[last][1]
    return b"".join([*parts, text[at:]])


def contamination(
    documents: DataFrame, benchmark: DataFrame, window: int = 10, shard_bytes: int = SHARD_BYTES, pass_bytes: int = PASS_BYTES
) -> DataFrame:
    """doc_id, n_words, spans (first and last word of each stretch that is hit, merged), items (sorted item ids).

    A word is hit when it lies inside an occurrence of ``window`` consecutive words of a test item, or of a whole
    shorter item. Whole texts are read; one row per row of ``documents``. A null or empty text has no words; items
    without words have no windows; a null item_id hits but is not named; rows repeating an item_id are one item.

    Items are dealt into shards of about ``shard_bytes`` by a hash, and the automaton of each is built in a task and written
    to the checkpoint folder. Automata of up to ``pass_bytes`` in all, by their own measure, are broadcast for one
    pass over the documents; no item comes to the driver. A text's words run through an automaton wherever two
    neighbouring words are neighbours in some item, since no window can lie elsewhere. The documents are never shuffled.
    """
    two = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return _searched(two, benchmark, window, shard_bytes, pass_bytes).select("row.doc_id", "n_words", "spans", "items")


def decontaminate(
    documents: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5,
    shard_bytes: int = SHARD_BYTES, pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """``documents`` without the stretches that are hit, and without documents hit over more than ``max_coverage``.

    All columns stay; ``text`` loses the bytes from the first to the last word of each stretch. Texts without a hit
    are returned unchanged, null and empty ones too.
    """
    done = _searched(documents, benchmark, window, shard_bytes, pass_bytes, max_coverage)
    return restored(done, documents.columns)
