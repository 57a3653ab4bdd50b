"""Small tables that hold the awkward cases, and plain counterparts of the operators."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# Extra columns that carry names the operators use inside.
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, score double, dedup int, "
    "component_id bigint, digest string, length int, entities string, k0 int"
)


def texts(seed: int = 1) -> list[str | None]:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]

    def line(n=12):
        return " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."

    def prose(n):
        return "\n".join(line() for _ in range(n))

    base, passage = prose(12), prose(6)
    near = base.replace(base.split()[30], "changed", 1)
    long = prose(1500)
    made: list[str | None] = [None, "", " \n\t ", "!", "One", "two words", "Three little words", base, base, near, base.upper()]
    made += [prose(rng.randint(1, 15)) for _ in range(30)]
    made += [f"{prose(3)}\n{passage}\n{prose(k)}" for k in range(5)]
    made += [long, long + " end", "aaaa " * 300, "a" * 5000, "x\n" * 40, "Größe ÉTÉ İstanbul ǅ 中文 😀 é   ß\x1f."]
    made += ["<|endoftext|> in a <|startoftext|>text<|endoftext|>", "don't we'll I'D   tabs\t\there  ", "  lead and trail  "]
    made += [prose(4).replace(" ", "  ", 3), "Reach me at Ann.B@Mail.example.com or +1 (469) 555-8958, 10.0.0.1"]
    return made


def documents(spark, seed: int = 1, extra: int = 0):
    """The texts under ids in mixed order, a row without id, a repeated row, and an id with two texts."""
    rows = [
        (k * 3 % 101 + (k // 101) * 101, t, "en", None if k % 7 == 0 else f"s{k % 3}", len(t or ""), "r", 0.5, k, k, "d", 1, "e", 0)
        for k, t in enumerate(texts(seed))
    ]
    rows.append((None, rows[7][1], None, None, None, None, None, None, None, None, None, None, None))
    rows.append(rows[12])
    rows.append((rows[13][0], "another text for the same id and a few words more", *rows[13][2:]))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def shingle_sets(rows, width):
    sets = []
    for text in rows:
        words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(ASCII_LOWER))
        k = min(width, len(words))
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set())
    return sets


def smallest_reachable(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def jaccard_links(sets, num, den):
    """Index pairs that link, by comparing all that share a shingle."""
    where = defaultdict(list)
    for k, s in enumerate(sets):
        for item in s:
            where[item].append(k)
    shared = Counter((a, b) for rows in where.values() for i, a in enumerate(rows) for b in rows[i + 1 :])
    return [(a, b) for (a, b), n in shared.items() if den * n >= num * (len(sets[a]) + len(sets[b]) - n)]


def benchmark_hits(text, items, window):
    """(number of words, positions hit, item ids) by looking for every window everywhere."""
    pattern = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
    words = re.findall(pattern, (text or "").translate(ASCII_LOWER))
    hit, names = set(), set()
    for name, item in items:
        own = re.findall(pattern, (item or "").translate(ASCII_LOWER))
        size = min(window, len(own))
        for k in range(len(own) - size + 1) if own else ():
            part = own[k : k + size]
            for i in range(len(words) - size + 1):
                if words[i : i + size] == part:
                    hit |= set(range(i, i + size))
                    names.add(name)
    return len(words), hit, names


def repeated_bytes(rows, length=200):
    """Per text, which bytes lie in a string of ``length`` that starts elsewhere too."""
    data = [(t or "").encode() for t in rows]
    seen = Counter(b[k : k + length] for b in data for k in range(len(b) - length + 1))
    marks = []
    for b in data:
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        marks.append(gone)
    return data, marks


def line_cuts(rows):
    """Per (id, text) in order, the lines that a later equal three-line window covers."""
    seen, gone = set(), {}
    for key in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        lines = key[1].split("\n") if key[1] is not None else []
        cut = set()
        for k in range(len(lines) - 2):
            window = tuple(lines[k : k + 3])
            if window in seen:
                cut |= {k, k + 1, k + 2}
            seen.add(window)
        gone[key] = cut
    return gone
