"""Replacement of personal data by keyed, type-consistent surrogates."""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cartlight.llm.rows import others, restored
from cartlight.llm.scratch import Scratch

# Given names by script and gender. A surrogate comes from the same list.
GIVEN_NAMES = {
    ("latin", "f"): "Alice Anna Camille Carmen Charlotte Claire Elena Emma Greta Hannah Ingrid Jane Julia Laura Lucia "
    "Maria Marie Martha Mary Olivia Petra Rosa Sarah Sofia Susan Ursula".split(),
    ("latin", "m"): "Andreas Antoine Carlos Charles Daniel David Diego Felix Frank George Hans Henri Jacques James John "
    "Jorge Juan Karl Louis Michael Otto Paul Peter Pierre Robert Thomas".split(),
    ("cyrillic", "f"): "Анна Елена Ирина Мария Наталья Ольга Светлана Татьяна".split(),
    ("cyrillic", "m"): "Алексей Андрей Дмитрий Иван Михаил Николай Пётр Сергей".split(),
    ("greek", "f"): "Άννα Ελένη Κατερίνα Μαρία Σοφία".split(),
    ("greek", "m"): "Ανδρέας Γιάννης Γιώργος Κώστας Νίκος".split(),
}
_GIVEN = {name: kind for kind, names in GIVEN_NAMES.items() for name in names}


def _spellings(name: str) -> set[str]:
    """A name in lower case, also as capitals are written: Greek without accents, Cyrillic with Е for Ё."""
    low = name.lower()
    script = _GIVEN[name][0]
    plain = "".join(c for c in unicodedata.normalize("NFD", low) if not unicodedata.combining(c))
    return {low, *([plain] if script == "greek" else [low.replace("ё", "е")] if script == "cyrillic" else [])}


_CASEFOLDED = {name.casefold(): name for name in _GIVEN}
_NAME_KEYS = {low: name for name in _GIVEN for low in _spellings(name)}

# The words that announce a secret, alone or within an identifier. Also read by Spark, in the same meaning.
_SECRET_WORD = r"(?:token|passw(?:or)?d|passphrase|pwd|secret|(?:api|access|private)[ _-]?key)"
_SECRET_HINTS = ("token", "passw", "passphrase", "pwd", "secret", "key")

# What is found, most specific first; a later kind takes no part of an earlier one.
PATTERNS = [
    ("email", re.compile(r"\b[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\b")),
    # The word, the rest of its identifier (not of a word: no tokenizer, no secretary), a quote, the sign, the value:
    # up to the closing quote, else to white space or to a sign that parts it from a next name.
    ("secret", re.compile(
        rf"(?ai:{_SECRET_WORD})(?:[A-Z0-9_-][A-Za-z0-9_-]{{0,255}}+)?\\?[\"'`]?\]?\s*(?:=>|:=|={{1,3}}|:)\s*"
        r"(?:\"((?:[^\"\\\n]|\\.){8,}+)\"|'((?:[^'\\\n]|\\.){8,}+)'"
        r"|\\?[\"'`]?((?:[^\s\"'`&,;]|[&,;](?!\s*[\w.-]+(?: [\w.-]+)?\s*[=:])){8,}))"
    )),
    ("ip", re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)")),
    ("card", re.compile(r"(?<![\w-])\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,7}(?![\w-])|(?<![\w-])3\d{3}([ -])\d{6}\2\d{5}(?![\w-])")),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    # With + or 00 and the country; an area code in brackets; groups of 3, 3 and 4, with blanks only as in North America.
    ("phone", re.compile(r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)"
                         r"|(?<![\w+])\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\w)"
                         r"|(?<![\w+.-])00[1-9]\d{0,2}[ .-](?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)"
                         r"|(?<![\w+.-])(?:1[ .-])?(?:\(\d{3}\)[ .-]?\d{3}[ .-]|\d{3}[.-]\d{3}[.-]|[2-9]\d\d[ .-][2-9]\d\d[ .-])\d{4}(?!\w|[.-]\d)")),
    # A capitalised word, an initial, and the word after it, which may be a surname: with apostrophes and hyphens
    # inside, but without a genitive 's.
    ("name", re.compile(r"(?<![^\W\d_])([^\W\d_a-zà-öø-ÿ][^\W\d_]+)"
                        r"(?=(?:(?: +[^\W\d_]\.)* +([^\W\d_](?:[^\W\d_]|['’-](?<!['’](?=[sS](?![^\W\d_])))(?=[^\W\d_]))+))?)")),
]


def _maybe() -> str:
    """A pattern of Spark's without which a text holds no entity: cheap at every position.

    An e-mail has its @. All kinds of digits but a phone number with + begin and end with a digit and have five or more
    digits, dots, blanks, hyphens and brackets between; \\d is any decimal digit, \\p{Nd}. A secret has its word, told
    alike by both. A given name begins with a capital, has no letters beside it, and is a known spelling in lower case.
    """
    first: dict[str, list[str]] = {}
    for name in sorted(_NAME_KEYS):
        first.setdefault(name[0], []).append(name[1:])
    names = "|".join(f"{letter}(?:{'|'.join(rest)})" for letter, rest in first.items())
    digits = r"\p{Nd}[\p{Nd}.() -]{5,}\p{Nd}|\+\p{Nd}[\p{Nd}.() -]{3,}"
    secret = rf"(?=[tpsaTPSA])(?i:{_SECRET_WORD})"
    return rf"@|{digits}|{secret}|(?<!\p{{L}})(?=\p{{Lu}})(?iu:{names})(?!\p{{L}})"


_MAYBE = _maybe()


def find_entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities of a text, in order and apart. A person's names are two entities."""
    found: list[tuple[int, int, str]] = []
    for kind, pattern in PATTERNS:
        if kind == "email" and "@" not in text:
            continue
        if kind == "secret":
            low = text.lower()
            if not any(word in low for word in _SECRET_HINTS):
                continue
        for m in pattern.finditer(text):
            if kind == "secret":
                start, end = m.span(m.lastindex)
                if m.lastindex == 3:  # without quotes: punctuation of the sentence is not its own
                    end = start + len(m.group(3).rstrip(".,;:)]}>\\"))
                if end - start < 8 or not any(c.isalnum() for c in text[start:end]):
                    continue  # a mask, or a rule of signs
                spans = [(start, end, kind)]
            elif kind == "name":
                if not m.group(1)[0].isupper() or m.group(1).lower() not in _NAME_KEYS:
                    continue
                spans = [(*m.span(1), "given")]
                if m.group(2) and m.group(2)[0].isupper():
                    spans.append((*m.span(2), "surname"))
            else:
                spans = [(*m.span(), kind)]
            found += [s for s in spans if not any(s[0] < e and b < s[1] for b, e, _ in found)]
    return sorted(found)


def canonical(kind: str, mention: str) -> str:
    """What two mentions of one entity have in common. A phone number has its country, without + or 00."""
    if kind in ("phone", "card", "ssn"):
        digits = "".join(c for c in mention if c.isdigit())
        if kind == "phone" and "+" not in mention:
            return digits[2:] if digits.startswith("00") else "1" + digits if len(digits) == 10 else digits
        return digits
    if kind == "given" and mention.lower() in _NAME_KEYS:
        return _NAME_KEYS[mention.lower()].casefold()
    return mention.casefold() if kind in ("email", "given", "surname") else mention


def _luhn(digits: str) -> int:
    doubled = (int(c) * (2 if k % 2 == 0 else 1) for k, c in enumerate(reversed(digits)))
    return (10 - sum(d - 9 if d > 9 else d for d in doubled) % 10) % 10


class _Draw:
    """An endless keyed stream of numbers for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, value: str, attempt: int):
        self._parts, self._count, self._bytes = (key, f"{kind}|{attempt}|{value}".encode()), 0, b""

    def below(self, n: int) -> int:
        if len(self._bytes) < 4:
            key, message = self._parts
            self._bytes += hmac.new(key, self._count.to_bytes(4, "big") + message, hashlib.sha256).digest()
            self._count += 1
        value, self._bytes = int.from_bytes(self._bytes[:4], "big"), self._bytes[4:]
        return value % n


# Letters are drawn from those of their own script and kind, so that names stay pronounceable.
_LETTERS = [
    "aeiou", "bcdfghklmnprstvw", "áéíóúäöüàèêç", "аеиоу", "бвгдзклмнпрст", "αειου", "βγδζκλμνπρστ",
]


# After so many draws that were taken, the form of a secret or the length of a surname is given up.
_CROWDED = 8
_PLAIN = "abcdefghijklmnopqrstuvwxyz0123456789"


def _letter(draw: _Draw, c: str) -> str:
    if c.isdigit():
        return str(draw.below(10))
    low = c.lower()
    for letters in _LETTERS:
        if low in letters:
            new = letters[draw.below(len(letters))]
            return new.upper() if c.isupper() else new
    if "a" <= low <= "z":
        new = "jqxyz"[draw.below(5)]
        return new.upper() if c.isupper() else new
    if c.isalpha():
        block = ord(c) & ~15  # a neighbour in the same script
        near = [x for x in map(chr, range(block, block + 16)) if x.isalpha() and x.isupper() == c.isupper()]
        return near[draw.below(len(near))]
    return c


def surrogate(key: bytes, kind: str, value: str, attempt: int) -> str:
    """A stand-in for a canonical value: same kind, length, script and, for given names, gender."""
    draw = _Draw(key, kind, value, attempt)
    if kind == "given":
        name = _CASEFOLDED[value]
        order = sorted(GIVEN_NAMES[_GIVEN[name]], key=lambda n: hmac.new(key, n.encode(), hashlib.sha256).digest())
        return order[(order.index(name) + 1) % len(order)].casefold()  # a keyed cycle: one to one
    if kind == "email":
        name, domain = value.split("@", 1)
        host, top = domain.rsplit(".", 1)
        return "".join(_letter(draw, c) for c in name) + "@" + "".join(_letter(draw, c) for c in host) + "." + top
    if kind == "ip":
        return ".".join(str(1 + draw.below(254)) for _ in range(4))
    if kind == "card":
        body = value[0] + "".join(str(draw.below(10)) for _ in value[1:-1])
        valid = _luhn(value[:-1]) == int(value[-1])
        return body + (str(_luhn(body)) if valid else str(draw.below(10)))
    if kind == "phone" and len(value) == 11 and value[0] == "1":  # area and exchange begin with 2 to 9
        return "1" + "".join(str(2 + draw.below(8) if k in (0, 3) else draw.below(10)) for k in range(10))
    if kind == "phone":
        keep = 1 if value.startswith(("1", "7")) else 2  # the country stays
        return value[:keep] + "".join(str(draw.below(10)) for _ in value[keep:])
    if kind == "secret" and re.fullmatch("[0-9a-f]+", value):
        return "".join("0123456789abcdef"[draw.below(16)] for _ in value)
    if kind == "secret" and attempt >= _CROWDED:  # mostly signs, which stay
        return "".join(_PLAIN[draw.below(len(_PLAIN))] for _ in value)
    if kind == "surname" and attempt >= _CROWDED:  # short ones run out: a letter more
        value += next((c for c in reversed(value) if c.isalpha()), "") * (attempt // _CROWDED)
    return "".join(_letter(draw, c) for c in value)


def render(kind: str, mention: str, value: str) -> str:
    """The surrogate in the format of the mention: its punctuation, spaces and capitals."""
    if kind in ("phone", "card", "ssn"):
        own = "".join(c for c in mention if c.isdigit())  # a phone number: with 00, or without its country
        digits = iter(own[: max(0, len(own) - len(value))] + value[max(0, len(value) - len(own)) :])
        return "".join(next(digits) if c.isdigit() else c for c in mention)
    if kind == "given":
        return value.upper() if mention.isupper() and len(mention) > 1 else value.capitalize()
    if kind in ("email", "surname") and len(value) == len(mention):
        return "".join(v.upper() if c.isupper() else v for v, c in zip(value, mention))
    if kind == "surname":
        return value.upper() if mention.isupper() else value.capitalize()
    return value


def surrogate_table(scratch: Scratch, entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, surrogate) for distinct (kind, value): no two of a kind share one, and none is a real value.

    Collisions are looked for over all entities: of those that share a surrogate, the smallest value keeps it; the
    others, and whoever was given a real value, draw again until none is left. Given names are a closed list and are
    cycled one to one, so they may be real ones. Values so short that the draws run out raise.
    """
    shared = scratch.spark.sparkContext.broadcast(key)

    def draw(batches):
        for batch in batches:
            kinds, values, attempts = (batch.column(k).to_pylist() for k in range(3))
            made = [surrogate(shared.value, *x) for x in zip(kinds, values, attempts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], [*batch.schema.names, "surrogate"])

    kind = "kind string, value string, attempt int, surrogate string"
    table = scratch.keep(entities.withColumn("attempt", F.lit(0)).mapInArrow(draw, kind), "drawn")
    for _ in range(100):
        free = table.filter("kind <> 'given'")
        first = free.groupBy("kind", "surrogate").agg(
            F.min("value").alias("first"), F.count(F.lit(1)).alias("n")
        ).filter("n > 1").select("kind", "surrogate", "first")
        real = free.select("kind", F.col("value").alias("surrogate"), F.lit(True).alias("real"))
        judged = table.join(first, ["kind", "surrogate"], "left").join(real, ["kind", "surrogate"], "left")
        clash = (F.col("value") > F.col("first")) | F.col("real")
        again = scratch.keep(judged.filter(clash).select("kind", "value", (F.col("attempt") + 1).alias("attempt")), "clash")
        if again.isEmpty():
            return table.select("kind", "value", "surrogate")
        kept = table.join(again.select("kind", "value"), ["kind", "value"], "left_anti")
        after = scratch.keep(kept.unionByName(again.mapInArrow(draw, kind)), "drawn")
        scratch.drop(table)
        table = after
    raise ValueError("no surrogates left for some entities")


def replace_pii(documents: DataFrame, key: bytes, scratch: Scratch | None = None) -> DataFrame:
    """All columns of ``documents`` with ``text`` replaced, and ``entities``: array of (kind, start, end) in it.

    Every mention of an entity (e-mail, secret, IP address, card, social security and phone number, given name,
    surname after a given name) becomes the entity's surrogate, in the format of the mention. An entity has one
    surrogate over all documents, and two have two. It depends on ``key``, which must be kept secret.

    Texts without a sign of an entity are passed through. Of the others, mentions are found in the tasks, the distinct
    entities get their surrogates, and these are joined to the mentions; an entity in a third of all texts is one row of
    the table, and its mentions are split by adaptive execution. A text's mentions are bounded by its length.

    Null and empty texts stay, with no entities. Rows with equal doc_id and text get the same result; a null doc_id is
    kept. A column named ``entities`` of the input is replaced.
    """
    spark = documents.sparkSession
    scratch = scratch or Scratch(spark, "pii")
    rows = documents.drop("entities")
    columns = rows.columns
    rows = rows.select(
        others(rows), F.col("text").cast("string").alias("text"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit((1 << 63) - 1)).alias("k0"), F.xxhash64("text").alias("k1"),
    )
    maybe = F.coalesce(F.col("text").rlike(_MAYBE), F.lit(False))

    def find(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for k0, k1, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                for start, end, kind in find_entities(text):
                    mention = text[start:end]
                    for column, x in zip(out, (k0, k1, start, end, kind, mention, canonical(kind, mention))):
                        column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            names = ("k0", "k1", "start", "end", "kind", "mention", "value")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], list(names))

    mentions = scratch.keep(
        rows.filter(maybe).select("k0", "k1", "text").mapInArrow(
            find, "k0 bigint, k1 bigint, start bigint, end bigint, kind string, mention string, value string"
        ), "mentions",
    )
    table = surrogate_table(scratch, mentions.select("kind", "value").distinct(), key)
    per_text = mentions.join(table, ["kind", "value"]).select(
        "k0", "k1", F.struct("start", "end", "kind", "mention", "surrogate").alias("m")
    ).distinct().groupBy("k0", "k1").agg(F.sort_array(F.collect_list("m")).alias("mentions"))
    per_text = scratch.keep(per_text, "per-text")
    scratch.drop(mentions, table)

    def replace(batches):
        for batch in batches:
            texts, entities = [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("mentions").to_pylist()):
                at, parts, size, told = 0, [], 0, []
                for m in found or []:
                    new = render(m["kind"], m["mention"], m["surrogate"])
                    parts += [text[at : m["start"]], new]
                    size += m["start"] - at
                    told.append({"kind": m["kind"], "start": size, "end": size + len(new)})
                    size, at = size + len(new), m["end"]
                texts.append(text if not found else "".join([*parts, text[at:]]))
                entities.append(told)
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(texts, pa.string()), pa.array(entities, kind)],
                ["row", "text", "entities"],
            )

    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>").alias("entities")
    schema = rows.select("row", "text", empty).schema
    changed = rows.filter(maybe).join(per_text.hint("merge"), ["k0", "k1"], "left").select("row", "text", "mentions").mapInArrow(
        replace, schema
    )
    done = changed.unionByName(rows.filter(~maybe).select("row", "text", empty))
    return restored(done, columns, "entities")
