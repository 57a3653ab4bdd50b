"""N-gram Jaccard join by grouped prefixes."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from cartlight.llm.components import components
from cartlight.llm.scratch import Scratch

# Width of the count sketch that orders the shingles (one byte each when broadcast: 4 MB, whatever the input), and of
# the pieces in which it is added up.
_SKETCH_BITS = 22
_PIECE_BITS = 16
_PARITY_BITS = 1024


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's runs of ``width`` words.

    A-Z are lower-cased and words end at ASCII white space. Fewer words make one shingle of all of them; no words,
    none.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total *= np.uint64(0x100000001B3 + 2 * k)
        total += _mixed(hashes[k : k + n] + np.uint64(k + 1))
    return np.unique(_mixed(total))


def _text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    for batch in batches:
        yield batch.column(0).to_pylist(), batch.column(1).to_pylist()


def _sketch(docs: DataFrame, width: int) -> np.ndarray:
    """Per cell of a fixed-width count sketch, log2 of the number of documents' shingles that fall into it."""
    cells, piece = 1 << _SKETCH_BITS, 1 << _PIECE_BITS

    def count(batches):
        total = np.zeros(cells, np.uint32)
        for _, texts in _text_batches(batches):
            found = [shingles(t, width) for t in texts]
            if found:
                place = np.concatenate(found) >> np.uint64(64 - _SKETCH_BITS)
                np.add.at(total, place.astype(np.int64), np.uint32(1))  # in place: a count of all cells would take 32 MB
        parts = [(k, total[k * piece : (k + 1) * piece]) for k in range(cells // piece)]
        parts = [(k, zlib.compress(p.astype(np.uint64).tobytes(), 1)) for k, p in parts if p.any()]
        yield pa.RecordBatch.from_pydict({
            "piece": pa.array([k for k, _ in parts], pa.int32()), "counts": pa.array([c for _, c in parts], pa.binary()),
        })

    def add(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = np.frombuffer(zlib.decompress(blob), np.uint64)
                totals[k] = totals[k] + values if k in totals else values
        logs = {k: np.ceil(np.log2(v + np.uint64(1))).astype(np.uint8).tobytes() for k, v in totals.items()}
        yield pa.RecordBatch.from_pydict({
            "piece": pa.array(list(logs), pa.int32()), "counts": pa.array(list(logs.values()), pa.binary()),
        })

    schema = "piece int, counts binary"
    parts = docs.mapInArrow(count, schema).repartition(cells // piece, "piece").mapInArrow(add, schema)
    out = np.zeros(cells, np.uint8)
    for row in parts.collect():  # at most one byte a cell
        out[row["piece"] * piece : (row["piece"] + 1) * piece] = np.frombuffer(bytes(row["counts"]), np.uint8)
    return out


def _profiles(docs: DataFrame, width: int, num: int, den: int, sketch) -> DataFrame:
    """Per row: set size, set digest, prefix in the order (frequency class, hash), its digest, parity bits."""

    def profile(batches):
        for ids, texts in _text_batches(batches):
            n, digests, prefixes, keys, parities, common = [], [], [], [], [], []
            for text in texts:
                found = shingles(text, width)
                size = len(found)
                n.append(size)
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                level = sketch.value[(found >> np.uint64(64 - _SKETCH_BITS)).astype(np.int64)]
                length = size - (num * size + den - 1) // den + 1 if size else 0
                prefix = found[np.argsort(level, kind="stable")[:length]]
                prefixes.append(prefix.view(np.int64))
                keys.append(hashlib.blake2b(prefix.tobytes(), digest_size=16).digest())
                bits = np.bincount((found & np.uint64(_PARITY_BITS - 1)).astype(np.int64), minlength=_PARITY_BITS) & 1
                parities.append(np.packbits(bits.astype(np.uint8)).view(np.int64))
                common.append(int(level.sum(dtype=np.int64)) * 100 // size if size else 0)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(ids, pa.int64()), "n": pa.array(n, pa.int64()),
                "digest": pa.array(digests, pa.binary()), "prefix": pa.array(prefixes, pa.list_(pa.int64())),
                "prefix_digest": pa.array(keys, pa.binary()), "parity": pa.array(parities, pa.list_(pa.int64())),
                "common": pa.array(common, pa.int64()),
            })

    return docs.mapInArrow(
        profile,
        "doc_id bigint, n bigint, digest binary, prefix array<bigint>, prefix_digest binary, parity array<bigint>, "
        "common bigint",
    )


def ngram_join(
    documents: DataFrame, width: int = 5, num: int = 8, den: int = 10, scratch: Scratch | None = None
) -> DataFrame:
    """Group documents whose sets of ``width``-word shingles have Jaccard similarity of at least ``num / den``.

    Returns one row per row of ``documents``: doc_id, n_shingles, class_id (smallest doc_id with the same set),
    component_id (smallest doc_id reachable by links). Exact: no link between different sets is lost.

    1. Equal sets become one class.
    2. A class's shingles are put in one global order, rarest first by a fixed-width count sketch. Two sets that
       link share a shingle among their first ``n - ceil(t n) + 1``. Classes of equal size and prefix form a group.
    3. A posting list is the groups that share a prefix shingle. Every group is first paired with the list's most
       typical group, and every class with the most typical one of its group. These few pairs are verified and make
       components.
    4. Only pairs between different components are left. Of each list, the members outside its largest component are
       paired with all, filtered by size and position, expanded to classes and verified. A large group of copies is
       one component by then, so its pairs are never formed.

    Verification bounds the overlap by parity bits, then intersects the sets.

    Nulls and empty texts have no shingles and link with nothing; a row without doc_id gets the component of equal
    sets with an id, if any, else null. Rows repeating a doc_id are compared row by row. Other columns are ignored.
    """
    spark = documents.sparkSession
    scratch = scratch or Scratch(spark, "ngram-join")
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    sketch = spark.sparkContext.broadcast(_sketch(docs, width))
    rows = scratch.keep(_profiles(docs, width, num, den, sketch), "profiles")

    # One representative per set; its id stands for the class. The aggregate combines copies in the map tasks.
    named = rows.filter("n > 0 and doc_id is not null")
    # What is joined back is written first: then adaptive execution splits the join where many share a key.
    firsts = scratch.keep(named.groupBy("n", "digest").agg(F.min("doc_id").alias("class_id")), "firsts")
    described = named.select(
        "n", "digest", F.col("doc_id").alias("class_id"), "prefix", "prefix_digest", "parity", "common")
    classes = scratch.keep(
        firsts.join(described, ["class_id", "n", "digest"]).drop("digest").dropDuplicates(["class_id", "n", "prefix_digest"]),
        "classes",
    )
    groups = scratch.keep(
        classes.groupBy("n", "prefix_digest").agg(
            F.max_by("class_id", F.struct("common", "class_id")).alias("group_id"), F.count(F.lit(1)).alias("members"),
        ),
        "groups",
    )
    members = classes.select("class_id", "n", "prefix_digest").join(
        groups.select("n", "prefix_digest", "group_id", "members"), ["n", "prefix_digest"]
    ).select("class_id", "group_id", "members")
    members = scratch.keep(members, "members")

    # How typical a group is, with bits of its id below: one number, so that the greatest of a list names its group. Two
    # groups that agree in all of it are both paired with the list.
    typical = F.col("common") * (1 << 49) + F.xxhash64("group_id").bitwiseAND((1 << 49) - 1)
    postings = (
        classes.join(groups.select("n", "prefix_digest", "group_id"), ["n", "prefix_digest"])
        .filter("class_id = group_id")
        .select("group_id", "n", typical.alias("typical"), F.posexplode("prefix").alias("pos", "token"))
    )
    # Two numbers a list are added up by hash, not sorted as rows of their own; most lists end here, with one group.
    shared = postings.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.max("typical").alias("most")).filter("m > 1")
    lists = scratch.keep(
        postings.join(shared, "token")
        .select("token", "group_id", "n", "pos", (F.col("typical") == F.col("most")).alias("is_pivot")),
        "lists",
    )
    pivots = scratch.keep(
        lists.filter("is_pivot").select("token", F.struct("group_id", "n", "pos").alias("pivot")), "pivots"
    )

    def fits(n1, p1, n2, p2):
        """Size and position filter: the rest of both sets must still hold the overlap that a link needs."""
        need = (num * (n1 + n2) + (num + den - 1)) / (num + den)
        small, large = F.least(n1, n2), F.greatest(n1, n2)
        return (den * small >= num * large) & (1 + F.least(n1 - p1 - 1, n2 - p2 - 1) >= F.floor(need))

    near = lists.join(pivots, "token").filter(
        (F.col("group_id") != F.col("pivot.group_id"))
        & fits(F.col("n"), F.col("pos"), F.col("pivot.n"), F.col("pivot.pos"))
    ).select(F.col("group_id").alias("a"), F.col("pivot.group_id").alias("b"))
    inside = members.filter("members > 1 and class_id <> group_id").select(
        F.col("class_id").alias("a"), F.col("group_id").alias("b")
    )
    tried = scratch.keep(_plausible(_pairs(near.unionByName(inside)), classes, num, den), "near")
    linked = _verified(scratch, docs, tried, width, num, den)
    comp = components(scratch, linked)

    # What is left: pairs of different components within a list, or within a group.
    labelled = members.join(comp, members.class_id == comp.node, "left").select(
        "class_id", "group_id", F.coalesce("component", "class_id").alias("component")
    )
    labelled = scratch.keep(labelled, "labels")
    spread = lists.select("token", "group_id", "n", "pos").unionByName(
        members.filter("members > 1 and class_id = group_id").join(groups.select("group_id", "n"), "group_id")
        .select(F.xxhash64(F.lit("group"), "group_id").alias("token"), "group_id", "n", F.lit(0).alias("pos"))
    ).join(labelled, "group_id").select("token", "n", "pos", "class_id", "component")
    counted = spread.groupBy("token", "component").agg(F.count(F.lit(1)).alias("m"))
    mixed = counted.groupBy("token").agg(
        F.count(F.lit(1)).alias("parts"), F.max(F.struct("m", "component")).alias("largest")
    ).filter("parts > 1").select("token", F.col("largest.component").alias("largest"))
    open_lists = scratch.keep(spread.join(mixed, "token"), "open")
    left = open_lists.filter("component <> largest").select(
        "token", F.col("class_id").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"),
        F.col("component").alias("ca"),
    )
    right = open_lists.select(
        "token", F.col("class_id").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"),
        F.col("component").alias("cb"),
    )
    rest = left.join(right, [
        left.token == right.token, F.col("ca") != F.col("cb"),
        fits(F.col("na"), F.col("pa"), F.col("nb"), F.col("pb")),
    ]).select("a", "b")
    rest = _pairs(rest).join(tried.select("a", "b"), ["a", "b"], "left_anti")
    rest = scratch.keep(_plausible(rest, classes, num, den), "rest")
    scratch.drop(lists, pivots, open_lists, labelled, groups, tried)
    more = _verified(scratch, docs, rest, width, num, den)
    if not more.isEmpty():
        comp = components(scratch, linked.unionByName(more))
    scratch.drop(linked, more, rest, members)

    ids = firsts.join(comp, firsts.class_id == comp.node, "left").select(
        "n", "digest", "class_id", F.coalesce("component", "class_id").alias("component_id")
    )
    ids = scratch.keep(ids, "ids")
    scratch.drop(firsts)
    found = rows.filter("n > 0").select("doc_id", "n", "digest").join(ids, ["n", "digest"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), "class_id", "component_id"
    )
    empty = rows.filter("n = 0").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("class_id"),
        F.col("doc_id").alias("component_id"),
    )
    return found.unionByName(empty)


def _pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()


def _plausible(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose parity bits allow a link: each differing bit needs a shingle that only one of the two has."""
    bits = classes.select("class_id", "n", "parity")
    one = bits.select(F.col("class_id").alias("a"), F.col("n").alias("na"), F.col("parity").alias("bits_a"))
    two = bits.select(F.col("class_id").alias("b"), F.col("n").alias("nb"), F.col("parity").alias("bits_b"))
    differ = F.aggregate(
        F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x
    )
    both = pairs.join(one, "a").join(two, "b")
    return both.filter((num + den) * differ <= (den - num) * (F.col("na") + F.col("nb"))).select("a", "b").distinct()


def _verified(scratch: Scratch, docs: DataFrame, pairs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs whose sets link, written. Only the texts of paired classes are made into sets."""
    wanted = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()

    def to_sets(batches):
        for ids, texts in _text_batches(batches):
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(ids, pa.int64()),
                "items": pa.array([shingles(t, width).view(np.int64) for t in texts], pa.list_(pa.int64())),
            })

    sets = docs.join(wanted, "doc_id", "left_semi").mapInArrow(to_sets, "doc_id bigint, items array<bigint>")
    sets = scratch.keep(sets, "sets")
    one = sets.select(F.col("doc_id").alias("a"), F.col("items").alias("items_a"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("items").alias("items_b"))
    overlap = F.size(F.array_intersect("items_a", "items_b"))
    total = F.size("items_a") + F.size("items_b")
    linked = pairs.join(one, "a").join(two, "b").filter((num + den) * overlap >= num * total)
    linked = scratch.keep(linked.select("a", "b").distinct(), "links")
    scratch.drop(sets)
    return linked
