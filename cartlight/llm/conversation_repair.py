"""Cheapest repairs of conversation structure, in one sorted stream."""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cartlight.llm.scratch import Scratch

# Bytes of a conversation's texts, and of its backpointers, that a task holds in memory; the rest waits in its own
# temporary file. Rows in a batch that is sent on.
_HELD, _OUT = 8 << 20, 2000
# White space of the contract: blank, and tab to carriage return.
_SPACE = " \t\n\x0b\x0c\r"

# Roles so far: none, s, (ua)*u, (ua)*a. What comes next if a role is put in, and the insertions that make an end.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_ROLE = {_USER: "user", _ASSISTANT: "assistant"}
_THEN = {_START: _USER, _SYSTEM: _USER, _USER: _ASSISTANT, _ASSISTANT: _USER}
_TO_END = {_START: 0, _SYSTEM: 2, _USER: 1, _ASSISTANT: 0}
_KEPT = {(_START, "s"): _SYSTEM, (_START, "u"): _USER, (_SYSTEM, "u"): _USER, (_ASSISTANT, "u"): _USER, (_USER, "a"): _ASSISTANT}
_OPS = "DKR"
_RECORD = 3  # bytes of backpointers a row


@cache
def _step(config: tuple, gone: bool, initial: str, cut: bool) -> tuple[tuple, int, bytes]:
    """One row onwards: the new configuration, what all costs rose by, and the backpointers of the four states.

    A configuration has, for each state, (cost above the least, place of its audit among the states' audits) or None.
    A row is used up by its own edit after up to two insertions. Such steps are never prefixes of one another, and
    audits of equal cost are none either, as an insertion costs; so of equal costs the least (place, step) has the
    least audit. There are few configurations, and each is worked out once in a worker.
    """
    best: dict[int, tuple] = {}
    for state, reached in enumerate(config):
        if reached is None:
            continue
        cost, place = reached
        now = state
        for inserts in range(3):
            edits = [("D", 3, now)]
            if not gone:
                edits.append(("R", 2 + cut, _THEN[now]))
                if (now, initial) in _KEPT:
                    edits.append(("K", int(cut), _KEPT[now, initial]))
            for op, price, target in edits:
                made = (cost + 2 * inserts + price, place, "I" * inserts + op, state)
                best[target] = min(best.get(target, made), made)
            now = _THEN[now]
    least = min(b[0] for b in best.values())
    order = sorted(best, key=lambda s: best[s][1:3])
    after = tuple((best[s][0] - least, order.index(s)) if s in best else None for s in range(4))
    record = 0
    for s, (_, _, step, origin) in best.items():
        record |= (origin | (len(step) - 1) << 2 | _OPS.index(step[-1]) << 4) << 6 * s
    return after, least, record.to_bytes(_RECORD, "little")


class _Spool:
    """Bytes that go to a temporary file of the task once they are many."""

    def __init__(self):
        self._file, self.size = tempfile.SpooledTemporaryFile(max_size=_HELD), 0

    def add(self, data: bytes) -> None:
        self._file.write(data)
        self.size += len(data)

    def read(self, at: int, n: int) -> bytes:
        self._file.seek(at)
        return self._file.read(n)

    def put(self, at: int, data: bytes) -> None:
        self._file.seek(at)
        self._file.write(data)

    def messages(self, rows: int) -> Iterator[tuple]:
        self._file.seek(0)
        for _ in range(rows):
            yield pickle.load(self._file)

    def close(self) -> None:
        self._file.close()


class _Conversation:
    """The facts of one conversation, row by row, and its cheapest repair at the end."""

    def __init__(self):
        self.turns = [None, None, 0, None]  # least, greatest, number of different ones, last
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = self.rows = 0
        self.config: tuple = ((0, 0), None, None, None)
        self.before = None
        self.texts, self.pointers = _Spool(), _Spool()

    def add(self, turn: int | None, role: str, text: str, later: bool, blank: bool, unended: bool) -> None:
        duplicate = not blank and (later or self.before == (turn, role, text))
        truncated = unended and not blank and not duplicate
        if turn is not None:
            low, _, different, last = self.turns
            self.turns = [turn if low is None else low, turn, different + (turn != last), turn]
        if self.before is not None:
            self.illegal += self.before[1][:1] + role[:1] not in ("su", "ua", "au")
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
        gone = blank or duplicate
        known = role[:1] if not gone and role[:1] in ("s", "u", "a") else ""
        self.config, rise, record = _step(self.config, gone, known, truncated)
        self.cost += rise
        self.rows += 1
        self.pointers.add(record)
        self.texts.add(pickle.dumps((role, "" if gone else text, turn)))
        self.before = (turn, role, text)

    def gaps(self) -> int:
        low, high, different, _ = self.turns
        return 0 if low is None else min(high - low + 1 - different, (1 << 63) - 1)

    def repaired(self) -> Iterator[tuple[str, str | None, str | None, int | None]]:
        """(edit, role, text, turn) in order, after which ``cost`` is whole. A deleted row has its old role and no text."""
        ends = [(c[0] + 2 * _TO_END[s], c[1], s) for s, c in enumerate(self.config) if c is not None]
        extra, _, state = min(ends)
        self.cost += extra
        last = state
        for end in range(self.rows, 0, -_HELD // _RECORD):  # the chosen steps take the place of the pointers
            start = max(0, end - _HELD // _RECORD)
            block = bytearray(self.pointers.read(start * _RECORD, (end - start) * _RECORD))
            for k in range(len(block) - _RECORD, -1, -_RECORD):
                step = int.from_bytes(block[k : k + _RECORD], "little") >> 6 * state & 63
                block[k], state = step, step & 3
            self.pointers.put(start * _RECORD, bytes(block))
        steps = (
            block[k]
            for at in range(0, self.rows * _RECORD, _HELD // _RECORD * _RECORD)
            for block in [self.pointers.read(at, _HELD // _RECORD * _RECORD)]
            for k in range(0, len(block), _RECORD)
        )
        now = _START
        for step, (role, text, turn) in zip(steps, self.texts.messages(self.rows)):
            for _ in range(step >> 2 & 3):
                now = _THEN[now]
                yield "I", _ROLE[now], "", None
            edit = _OPS[step >> 4]
            if edit == "D":
                yield "D", role, None, turn
                continue
            now = _KEPT[now, role[:1]] if edit == "K" else _THEN[now]
            yield edit, role if edit == "K" else _ROLE[now], text, turn
        for _ in range(_TO_END[last]):
            now = _THEN[now]
            yield "I", _ROLE[now], "", None

    def close(self) -> None:
        self.texts.close()
        self.pointers.close()


_FACTS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_MESSAGES = "place bigint, edit string, turn bigint, role string, text string"


def _facts(key: str | None, talk: _Conversation) -> Iterator[tuple]:
    audit, digest, first = [], hashlib.sha256(), True
    for edit, role, text, _ in talk.repaired():
        audit.append(edit)
        if edit != "D":
            digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
            first = False
    yield (key, talk.gaps(), talk.blank, talk.duplicate, talk.truncated, talk.illegal, talk.cost, "".join(audit), digest.hexdigest())


def _messages(key: str | None, talk: _Conversation) -> Iterator[tuple]:
    for place, (edit, role, text, turn) in enumerate(talk.repaired()):
        yield key, place, edit, turn, role, text


def _streamed(told, columns: list[str]):
    """A task over rows sorted by conversation and turn; a conversation may go on over any number of batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, key, talk = [], None, None

        def sent() -> pd.DataFrame:
            made = pd.DataFrame(out, columns=columns, dtype=object)
            out.clear()
            return made

        for batch in batches:
            for conv, dated, turn, role, text, present, later, blank, unended in zip(*[batch[c].tolist() for c in batch]):
                if talk is None or conv != key:
                    for row in told(key, talk) if talk is not None else ():
                        out.append(row)
                        if len(out) >= _OUT:
                            yield sent()
                    if talk is not None:
                        talk.close()
                    key, talk = conv, _Conversation()
                if present:
                    talk.add(turn if dated else None, role, text, later, blank, unended)
        if talk is not None:
            for row in told(key, talk):
                out.append(row)
                if len(out) >= _OUT:
                    yield sent()
            talk.close()
        yield sent()

    return run


def _sorted_rows(messages: DataFrame, present: Column) -> DataFrame:
    """What a task needs of every row, by conversation and turn; of equal turns by role and text."""
    scratch = Scratch(messages.sparkSession, "conversations")
    text = F.coalesce(F.col("text"), F.lit(" "))
    trimmed = F.rtrim(text, F.lit(_SPACE))
    rows = messages.select(
        F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role"), F.lit(" ")).alias("role"), text.alias("text"),
        F.coalesce(present, F.lit(False)).alias("present"), (trimmed == "").alias("blank"),
        (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("unended"),
    )
    said = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))).alias("said")
    when = F.struct(F.col("turn").isNotNull().alias("dated"), "turn")
    first = rows.filter("present and not blank").select("conv", said, when.alias("t")).groupBy("conv", "said").agg(
        F.min("t").alias("first"), F.max("t").alias("last")).filter("first <> last").select(
        F.col("conv").alias("_conv"), F.col("said").alias("_said"), F.col("first").alias("_first"))
    first = scratch.keep(first, "repeated")
    again = F.col("conv").eqNullSafe(F.col("_conv")) & (said == F.col("_said"))
    told = rows.join(first, again, "left").select(
        "conv", F.col("turn").isNotNull().alias("dated"), F.coalesce("turn", F.lit(0)).alias("turn"), "role",
        F.when(F.col("present"), F.col("text")).otherwise("").alias("text"), "present",
        F.coalesce(when > F.col("_first"), F.lit(False)).alias("later"), "blank", "unended",
    )
    return told.repartition("conv").sortWithinPartitions("conv", "dated", "turn", "role", "text")


def _run(messages: DataFrame, present: Column | None, told, schema: str) -> DataFrame:
    kind = messages.schema["conv_id"].dataType
    names = [f.split()[0] for f in schema.split(", ")]
    rows = _sorted_rows(messages, F.lit(True) if present is None else present)
    done = rows.mapInPandas(_streamed(told, ["conv", *names]), f"conv string, {schema}")
    return done.select(F.col("conv").cast(kind).alias("conv_id"), *names)


def conversation_repairs(messages: DataFrame, present: Column | None = None) -> DataFrame:
    """One row per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``messages``: conv_id, turn, role, text; rows for which ``present`` is not true name their conversation and play
    no other part. Rows come by turn, nulls first, and of equal turns by role and text. A row's first fault counts:
    blank (only white space), duplicate (role and text earlier in the conversation), truncated (not ended by . ! or ?).
    ``gaps``: turns missing between the least and the greatest (0 without turns; the largest long, if more);
    ``illegal``: neighbouring roles whose initials are not su, ua or au.

    ``audit`` has the initials of the cheapest edits that make the roles' initials match (s?(ua)+)?: Keep (0), Rerole
    to user or assistant (2), Delete (3, a must for blank and duplicate rows), Insert an empty user or assistant turn (2),
    where a truncated row that is not deleted adds 1; of equally cheap ones the least in ASCII. ``repaired_sha256`` is
    the digest of the repaired "role:text" lines, joined by line feeds.

    A null role or text is one blank. Rows of a null conv_id are one conversation. A conversation without present rows
    has zeros, an empty audit and the digest of the empty string. An empty table gives no rows. Other columns
    are ignored.

    Rows are dealt by conversation and sorted by turn; one pass carries the costs of four states across batches and
    notes three bytes of backpointers a row, by which the repair is read off at the end. Beyond some megabytes these, and
    the texts, wait in the task's temporary file, so that a conversation may be of any length. Whether a row
    repeats an earlier turn's is found beforehand by digests, which meet in groups of equal messages.
    """
    return _run(messages, present, _facts, _FACTS)


def repaired_messages(messages: DataFrame, present: Column | None = None) -> DataFrame:
    """The repaired conversations themselves: conv_id, place (from 0), edit, turn, role, text of every edit in order.

    Deleted rows stand there with edit D and without text, inserted ones with I and without turn. Everything else is
    said at ``conversation_repairs``.
    """
    return _run(messages, present, _messages, _MESSAGES)


def damage(messages: DataFrame) -> DataFrame:
    """Messages with faults put in by crc32 of "conv_id:turn" modulo 20, and ``present``, which is false for dropped rows.

    0 drops a row, 1 empties its text, 2 removes its . ! and ?, 3 repeats it, 4 makes its role user. Nulls are one blank,
    but for conv_id and turn themselves, which stay null.
    """
    def known(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(known("text"), ".!?", "")).otherwise(known("text"))
    copies = F.when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return messages.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(known("role")).alias("role"), text.alias("text"),
        (fault != 0).alias("present"), F.explode(copies).alias("copy"),
    ).drop("copy")
