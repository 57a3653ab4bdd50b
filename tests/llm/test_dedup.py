"""Joins and dedup operators against plain counterparts, on the awkward cases."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from cartlight.llm import embedding_dedup as embedding_module, substring_dedup
from cartlight.llm.components import components
from cartlight.llm.embedding_dedup import embedding_dedup
from cartlight.llm.line_dedup import line_dedup
from cartlight.llm.ngram_join import ngram_join, shingles
from cartlight.llm.scratch import Scratch
from cartlight.llm.substring_dedup import repeated_substrings
from tests.llm import data


@pytest.mark.parametrize("width, num, den", [(3, 90, 100), (5, 8, 10)])
def test_ngram_join_against_all_pairs(spark, width, num, den):
    docs = data.documents(spark)
    found = ngram_join(docs, width, num, den).collect()
    rows = docs.collect()
    sets = data.shingle_sets([r["text"] for r in rows], width)
    assert sorted((r["doc_id"] or -1, r["n_shingles"]) for r in found) == sorted(
        (r["doc_id"] or -1, len(s)) for r, s in zip(rows, sets)
    )
    # the id with two texts is compared row by row; all other rows have one component
    twice = next(r["doc_id"] for r in rows if r["text"] and r["text"].startswith("another text"))
    keep = [k for k, r in enumerate(rows) if r["doc_id"] is not None and r["doc_id"] != twice]
    links = [
        (rows[a]["doc_id"], rows[b]["doc_id"]) for a, b in data.jaccard_links(sets, num, den) if a in keep and b in keep
    ]
    want = data.smallest_reachable({rows[k]["doc_id"] for k in keep}, links)
    got = {r["doc_id"]: r["component_id"] for r in found if r["doc_id"] in want}
    assert got == want and len(set(want.values())) < len(want)
    base = next(r for r in rows if r["doc_id"] is None)
    same = min(r["doc_id"] for r in rows if r["text"] == base["text"] and r["doc_id"] is not None)
    assert next(r["component_id"] for r in found if r["doc_id"] is None) == got[same]


def test_ngram_join_of_a_chain_and_many_near_copies(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(120):  # a third of the rows differ from one text in a few words
        own = list(words)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(120)] = f"x{rng.random()}"
        rows.append((k, " ".join(own)))
    for k in range(40):  # a chain: only neighbours link
        rows.append((1000 + k, " ".join(f"c{i}" for i in range(k * 4, k * 4 + 130))))
    rows += [(2000 + k, " ".join(f"u{k}-{i}" for i in range(50)) + " a common ending of words") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join(docs, 3, 9, 10).collect()}
    sets = data.shingle_sets([t for _, t in rows], 3)
    links = [(rows[a][0], rows[b][0]) for a, b in data.jaccard_links(sets, 9, 10)]
    assert got == data.smallest_reachable([k for k, _ in rows], links)


def test_ngram_join_counts_its_lists_by_hash(spark):
    """The largest step, over all prefix shingles, sorts no rows to add them up."""
    class Watched(Scratch):
        def keep(self, df, name="t"):
            plans[name] = df._jdf.queryExecution().executedPlan().toString()
            return super().keep(df, name)

    plans: dict[str, str] = {}
    words = [f"w{k}" for k in range(60)]
    docs = spark.createDataFrame([(k, " ".join([*words, *["x"] * k])) for k in range(5)], "doc_id bigint, text string")
    got = {r["component_id"] for r in ngram_join(docs, 3, 9, 10, Watched(spark, "watched")).collect()}
    assert got == {0} and "HashAggregate" in plans["lists"] and "SortAggregate" not in plans["lists"]


def test_ngram_join_of_empty_tables(spark):
    assert ngram_join(data.empty_documents(spark)).collect() == []
    only = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    got = {tuple(r) for r in ngram_join(only).select("doc_id", "n_shingles", "component_id").collect()}
    assert got == {(1, 0, 1), (2, 0, 2)}


def test_shingles_lower_only_ascii():
    assert (shingles("A B C".encode(), 3) == shingles("a b c".encode(), 3)).all()
    assert set(shingles("É b c".encode(), 3)) != set(shingles("é b c".encode(), 3))
    assert len(shingles(b"a b a b a b", 3)) == 2


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    links += [(400 + k, 401 + k) for k in range(50)] + [(500, 500 + k) for k in range(100)] + [(7, None)]
    frame = spark.createDataFrame(links, "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in components(Scratch(spark, "test"), frame).collect()}
    whole = [x for x in links if None not in x]
    assert got == data.smallest_reachable({n for x in whole for n in x}, whole)
    assert components(Scratch(spark, "test"), frame.limit(0)).collect() == []


def test_line_dedup(spark):
    docs = data.documents(spark)
    rows = docs.select("doc_id", "text").collect()
    cuts = data.line_cuts([(r["doc_id"], r["text"]) for r in rows])
    want = []
    for r in rows:
        gone = cuts[r["doc_id"], r["text"]]
        text = r["text"] and "\n".join(x for k, x in enumerate(r["text"].split("\n")) if k not in gone)
        spans = sum(k - 1 not in gone for k in gone)
        want.append((r["doc_id"], text, len(r["text"].split("\n")) if r["text"] is not None else 0, len(gone), spans))
    done = line_dedup(docs)
    assert done.columns == [c for c in docs.columns if c != "dedup"] + ["dedup"]
    got = [(r["doc_id"], r["text"], *r["dedup"]) for r in done.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum(w[3] for w in want) > 40
    assert line_dedup(data.empty_documents(spark)).collect() == []


@pytest.mark.parametrize("block", [1 << 17, 997])
def test_substrings_against_brute_force(spark, monkeypatch, block):
    docs = data.documents(spark)
    rows = docs.select("doc_id", "text").collect()
    bytes_, marks = data.repeated_bytes([r["text"] for r in rows])
    want = sorted(
        (r["doc_id"] or -1, len(b), sum(m), bytes(x for x, gone in zip(b, m) if not gone))
        for r, b, m in zip(rows, bytes_, marks)
    )
    monkeypatch.setattr(substring_dedup, "_BLOCK", block)
    if block != 1 << 17:  # runs cut at block ends, in one process
        got = _representatives_cover(bytes_)
        assert got == [sum(m) for m in marks]
        return
    got = repeated_substrings(docs).collect()
    removed = [sum(s["end"] - s["start"] for s in r["spans"]) for r in got]
    assert sorted((r["doc_id"] or -1, r["n_bytes"], n, bytes(r["kept"])) for r, n in zip(got, removed)) == want
    assert all(a["end"] < b["start"] for r in got for a, b in zip(r["spans"], r["spans"][1:]))
    assert repeated_substrings(data.empty_documents(spark)).collect() == []


def _representatives_cover(texts):
    """Every start belongs to one run, and equal strings to runs with equal pointers."""
    ends = np.cumsum([len(t) for t in texts])
    stream = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.r_[0, ends[:-1]]
    starts = {}
    for text, low, high, _, pointer, *_ in substring_dedup.representatives(stream, ends):
        for t, a, b, p in zip(text.tolist(), low.tolist(), high.tolist(), pointer.tolist()):
            for s in range(a, b + 1):
                assert (t, s - begin[t]) not in starts
                starts[t, int(s - begin[t])] = p
    by_string, removed = {}, [set() for _ in texts]
    for (t, s), p in starts.items():
        by_string.setdefault(texts[t][s : s + 200], []).append((t, s, p))
    for places in by_string.values():
        assert len({p for _, _, p in places}) == 1
        if len(places) > 1:
            for t, s, _ in places:
                removed[t] |= set(range(s, s + 200))
    assert len(starts) == sum(max(0, len(t) - 199) for t in texts)
    return [len(r) for r in removed]


def _embeddings(seed=3, dims=32):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((400, dims))
    near = base[:60] + 0.1 * rng.standard_normal((60, dims))
    crowd = rng.standard_normal(dims) + 0.02 * rng.standard_normal((900, dims))
    rows = [list(map(float, v)) for v in np.r_[base, near, crowd, base[:5], 3 * base[5:8]]]
    return [(k, v, k % 4) for k, v in enumerate(rows)]


def test_embedding_recall_and_degrees(spark):
    rows = _embeddings()
    odd = [(9001, None, 0), (9002, [], 0), (9003, [0.0] * 32, 0), (9004, [float("nan")] * 32, 0),
           (9005, [None] + [1.0] * 31, 0), (9006, [float("inf")] * 32, 0), (9007, [1.0, 2.0], 1), (9008, [2.0, 4.0], 1),
           (None, rows[0][1], 1)]
    frame = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in embedding_dedup(frame, 0.95).collect()}
    unit = np.array([v for _, v, _ in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.95
    degree = close.sum(axis=1) - 1
    degree[np.flatnonzero(close[0])] += 1  # the row without id counts
    found = np.array([got[k]["n_links"] for k in range(len(rows))])
    assert (found <= degree).all() and found.sum() >= 0.97 * degree.sum()
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in range(9001, 9007))
    assert got[9008]["component_id"] == 9007 and not got[9008]["kept"]
    assert got[None]["component_id"] is None and not got[None]["kept"]
    assert len({got[k]["component_id"] for k in range(460, 1360)}) == 1
    assert embedding_dedup(frame.limit(0)).collect() == []


def test_embedding_recall_at_the_threshold(spark, monkeypatch):
    """Pairs at a cosine of 0.95 to 0.97 among other vectors, in a forest of ten levels or more, without a crowd."""
    depth = []
    fitted = embedding_module._fit_forest

    def fit(sample, total):
        cuts = fitted(sample, total)
        depth.append(max(node.bit_length() for _, node in cuts))
        return cuts

    monkeypatch.setattr(embedding_module, "LEAF", 24)
    monkeypatch.setattr(embedding_module, "LEAST", 12)
    monkeypatch.setattr(embedding_module, "_fit_forest", fit)
    rng = np.random.default_rng(12)
    base = rng.standard_normal((16_000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    pairs = 1500
    side = rng.standard_normal((pairs, 64))
    side -= (side * base[:pairs]).sum(axis=1, keepdims=True) * base[:pairs]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.9501, 0.97, (pairs, 1))
    twins = cosine * base[:pairs] + np.sqrt(1 - cosine**2) * side
    rows = [(k, v.tolist()) for k, v in enumerate(np.r_[base, twins])]
    got = {r["vec_id"]: r for r in embedding_dedup(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), 0.95).collect()}
    found = np.mean([got[len(base) + k]["component_id"] == k for k in range(pairs)])
    print(f"recall {found:.4f}, levels {depth}")
    assert min(depth) >= 10 and found >= 0.9
    assert sum(r["n_links"] for r in got.values()) == 2 * round(found * pairs)


def _one_hot_node(spark, scratch):
    links = spark.range(60_000).select((F.col("id") + 10).alias("a"), F.lit(3).cast("bigint").alias("b"))
    components(scratch, links.unionByName(spark.range(60_000).select((F.col("id") * 2 + 200_000).alias("a"), (F.col("id") * 2 + 200_001).alias("b"))))


def _one_hot_window(spark, scratch):
    text = F.when(F.col("id") % 10 > 0, "a\nb\nc").otherwise(F.concat_ws("\n", F.lit("x"), "id", F.col("id") % 20_000))
    line_dedup(spark.range(60_000).select(F.col("id").alias("doc_id"), text.alias("text")), scratch)


@pytest.mark.parametrize("job, step", [(_one_hot_node, "large"), (_one_hot_window, "cuts")])
def test_hot_keys_are_split(spark, monkeypatch, job, step):
    """A third of the rows at one key: what is joined back was written, so adaptive execution splits the join."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "64k",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    plans, keep = {}, Scratch.keep

    def keep_and_look(self, df, name="t"):
        if name == step:
            df._jdf.queryExecution().executedPlan().executeCollect()
            plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return keep(self, df.repartition(8) if name in ("links", "windows") else df, name)

    monkeypatch.setattr(Scratch, "keep", keep_and_look)
    scratch = Scratch(spark, "skew")
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        job(spark, scratch)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert any("skew=true" in plan for plan in plans[step])
