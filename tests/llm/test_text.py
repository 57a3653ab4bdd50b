"""Counting, packing, scanning, classifying and replacing, on the awkward cases."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cartlight.llm import packing
from cartlight.llm.decontaminate import _automata, _passes, contamination, decontaminate
from cartlight.llm.licence_scan import licence_scan
from cartlight.llm.licences import KNOWN
from cartlight.llm.packing import best_fit_pack, plan_packing, token_pieces
from cartlight.llm.pii import GIVEN_NAMES, canonical, find_entities, render, replace_pii, surrogate, surrogate_table
from cartlight.llm.quality import features, fit, fit_quality, quality
from cartlight.llm.scratch import Scratch
from cartlight.llm.token_counts import token_counts
from cartlight.llm.tokens import Encoder, as_bytes
from tests.llm import data

BYTE, WORD = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))


def test_token_counts_are_the_library_s(spark):
    docs = data.documents(spark)
    library = Tokenizer.from_file(BYTE)
    want = sorted(
        (r["doc_id"] or -1, len((r["text"] or "").encode()), len(library.encode(r["text"] or "", add_special_tokens=False).ids))
        for r in docs.collect()
    )
    assert sorted((r[0] or -1, r[1], r[2]) for r in token_counts(docs, BYTE).collect()) == want
    assert token_counts(data.empty_documents(spark), BYTE).collect() == []


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_on_every_quick_character(path):
    library = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        encoder = Encoder(file.read(), list)
    rng = random.Random(4)
    chars = [chr(c) for c in [*range(0, 0x260), *range(0x2000, 0x2070), 0x20AC]]
    texts = [f"a{c}b {c}{c}1 {c}'s{c} {c}" for c in chars]
    texts += ["".join(rng.choice(chars) for _ in range(60)) for _ in range(2000)]
    texts += ["a" * 3000, "'" * 50 + "s", " \n \t  x", "I'LL 'Re"]
    syllables = ["the", "er", "ing", "tion", "ung", "é", "ß", "qu", "st", "x", "1", "ñ", "-", "'s"]
    texts += [" ".join("".join(rng.choices(syllables, k=rng.randint(1, 9))) for _ in range(30)) for _ in range(500)]
    texts += ["ab" * n for n in (40, 60, 1000, 1500)]
    assert encoder._ranked is not None
    for text in texts:
        assert [i for part in encoder.values(text) for i in part] == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_of_whole_texts_are_the_library_s(path):
    library = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        encoder = Encoder(file.read(), as_bytes)
    rng = random.Random(9)
    usual = [chr(c) for c in [*range(0, 0x260), *range(0x2010, 0x2060), 0x20AC]]
    texts = [f"a{c}b {c}{c}1 {c}'s{c} .{c}'ll '{c} a'{c}" for c in usual]
    for pool in ("' .stmdrevl_1²é ", "'\"a-_s5½ \n\té€", usual):
        texts += ["".join(rng.choices(pool, k=rng.randint(1, 14))) for _ in range(1500)]
    texts += ["", " \n", "a" * 3000 + " b's", "'" * 2500, "one<|endoftext|>two", "日本 a'll", "x " * 600_000]
    for text in texts:
        assert encoder.id_bytes(text) == as_bytes(library.encode(text, add_special_tokens=False).ids)


def test_rare_words_are_merged_text_by_text():
    with open(WORD, encoding="utf-8") as file:
        encoder = Encoder(file.read(), as_bytes)
    assert encoder.id_bytes(" ".join(f"rare{chr(97 + k % 26)}{k}, word's" for k in range(500)))
    assert not encoder and not encoder._parts  # no word was encoded or remembered by itself


def test_pieces_are_the_library_s(spark):
    docs = data.documents(spark)
    library = Tokenizer.from_file(WORD)
    want = []
    for r in docs.collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        want += [(r["doc_id"] or -1, k, k * 64, tuple(ids[k * 64 : k * 64 + 64])) for k in range(-(-len(ids) // 64))]
    got = [
        (r["doc_id"] or -1, r["piece"], r["start"], tuple(np.frombuffer(r["ids"], "<u4").tolist()))
        for r in token_pieces(docs, WORD, 64).collect()
    ]
    assert sorted(got) == sorted(want)


def _layout(rows, capacity):
    """Number of sequences; every one is filled without gaps from 0 and holds at most the capacity."""
    rows = sorted(rows)
    at = {}
    for sequence, offset, length in rows:
        assert offset == at.get(sequence, 0)
        at[sequence] = offset + length
    assert max(at.values()) <= capacity
    return len(at)


@pytest.mark.parametrize("shape", ["mixed", "small", "over half", "copies", "full"])
def test_plan_places_every_item_once(shape):
    rng = np.random.default_rng(6)
    lengths = {
        "mixed": rng.integers(1, 513, 5000), "small": rng.integers(1, 20, 3000), "over half": rng.integers(257, 513, 300),
        "copies": np.r_[np.full(3000, 170), rng.integers(1, 513, 2000)], "full": np.full(50, 512),
    }[shape]
    counts = Counter(lengths.tolist())
    runs = plan_packing(counts, 512)
    ranks, rows = {}, []
    for length, first, n, sequence, each, offset in runs.tolist():
        ranks.setdefault(length, []).append((first, n))
        rows += [(sequence + k // each, offset + k % each * length, length) for k in range(n)]
    for length, spans in ranks.items():
        at = 0
        for first, n in sorted(spans):
            assert first == at
            at += n
        assert at == counts[length]
    best = max(-(-int(lengths.sum()) // 512), int((lengths > 256).sum()))
    assert _layout(rows, 512) <= 1.03 * best + 1


def test_packing_of_a_table(spark, monkeypatch):
    monkeypatch.setattr(packing, "_RANKED", 50)  # lengths are ranked in parts
    items = spark.range(2000).select(
        "id", (F.when(F.col("id") % 3 == 0, 40).otherwise(F.col("id") % 100 + 1)).cast("bigint").alias("length"),
        F.lit("x").alias("_rank2"),
    )
    items = items.unionByName(items.limit(20))
    rows = best_fit_pack(items, 128).collect()
    assert Counter((r["id"], r["length"]) for r in rows) == Counter((r["id"], r["length"]) for r in items.collect())
    total = sum(r["length"] for r in rows)
    assert _layout([(r["sequence_id"], r["offset"], r["length"]) for r in rows], 128) <= 1.05 * -(-total // 128)
    assert best_fit_pack(items.limit(0), 128).collect() == []
    with pytest.raises(ValueError):
        best_fit_pack(items.withColumn("length", F.lit(129).cast("bigint")), 128)


def _benchmark(spark, texts):
    passage = " ".join(texts[41].split()[20:60])
    items = [
        (1, passage), (2, " ".join(texts[42].split()[-30:])), (3, "little words"), (4, None), (5, " .,"), (6, "zebra"),
        (None, " ".join(texts[7].split()[5:20])), (1, passage), (7, "do re mi fa so la ti do re mi fa so"),
        (10, texts[12]), (11, "aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa aaaa"),
    ]
    return spark.createDataFrame([(*i, "x", 1) for i in items], "item_id bigint, text string, row string, n_words int"), items


@pytest.mark.parametrize("window, shard_bytes, pass_bytes", [(10, 10**6, 10**8), (4, 150, 10**8), (10, 150, 7000)])
def test_contamination_against_brute_force(spark, window, shard_bytes, pass_bytes):
    docs = data.documents(spark)
    benchmark, items = _benchmark(spark, data.texts())
    want = []
    for r in docs.collect():
        n, hit, names = data.benchmark_hits(r["text"], items, window)
        want.append((r["doc_id"] or -1, n, tuple(sorted(hit)), tuple(sorted(str(x) for x in names if x is not None))))
    got = []
    for r in contamination(docs, benchmark, window, shard_bytes, pass_bytes).collect():
        hit = [k for s in r["spans"] for k in range(s["first"], s["last"] + 1)]
        got.append((r["doc_id"] or -1, r["n_words"], tuple(hit), tuple(r["items"])))
    assert sorted(got) == sorted(want) and sum(bool(w[2]) for w in want) > 5
    assert contamination(data.empty_documents(spark), benchmark).collect() == []
    assert not any(r["items"] for r in contamination(docs, benchmark.limit(0)).collect())
    automata = _automata(Scratch(spark, "test"), benchmark, window, shard_bytes)
    assert (automata.count() > 3) == (shard_bytes < 1000)
    passes = _passes(automata, pass_bytes)
    assert (len(passes) > 2) == (pass_bytes < 10**5) and sum(map(len, passes)) == automata.count()


@pytest.mark.parametrize("shard_bytes, pass_bytes", [(10**6, 10**8), (150, 7000)])
def test_decontaminate_cuts_and_keeps(spark, shard_bytes, pass_bytes):
    docs = data.documents(spark)
    benchmark, items = _benchmark(spark, data.texts())
    done = decontaminate(docs, benchmark, 10, 0.5, shard_bytes, pass_bytes)
    assert done.columns == docs.columns
    after = Counter((r["doc_id"], r["text"]) for r in done.collect())
    for r in docs.collect():
        n, hit, _ = data.benchmark_hits(r["text"], items, 10)
        if not hit:
            assert after[r["doc_id"], r["text"]]
        if len(hit) > 0.5 * n:
            assert not after[r["doc_id"], r["text"]]
    assert not any(data.benchmark_hits(t, items[:2], 10)[1] for _, t in after)


def test_licences(spark):
    whole = KNOWN[0][1]
    rows = [
        (1, "Copyright (c) 2020 Some One\n\n" + whole.upper().replace("SUBLICENSE", "sub-licence")), (2, "No licence here."),
        (3, f"prose\n  released under the MIT LICENCE!\nmore\nAll rights reserved"), (4, None), (5, ""), (6, "?!"),
        (None, "Licensed under CC BY-NC 4.0"), (3, "other"), (7, whole + " and more"), (8, whole.replace("\n", " ")),
        (9, "SPDX-License-Identifier: MIT\nSPDX-License-Identifier: MIT"),
    ]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, digest string")
    got = {(r["doc_id"], r["licence"], r["notices"], r["n_notices"]) for r in licence_scan(docs).collect()}
    assert got == {
        (1, "MIT", "", 0), (2, None, "", 0), (3, None, "LicenseRef-all-rights-reserved,MIT", 2), (4, None, "", 0),
        (5, None, "", 0), (6, None, "", 0), (None, "CC-BY-NC-4.0", "CC-BY-NC-4.0", 1), (3, None, "", 0), (7, None, "", 0),
        (8, "MIT", "MIT", 1), (9, None, "MIT", 2),
    }
    assert len(licence_scan(data.documents(spark)).collect()) == data.documents(spark).count()
    assert licence_scan(data.empty_documents(spark)).collect() == []


def test_quality_learns_from_positives_and_unlabelled(spark):
    rng = random.Random(7)

    def text(good):
        words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(80)]
        return " ".join(words) if good else " ".join(w + rng.choice(["$$$", "!!", "%%%"]) for w in words)

    rows = [(k, text(k % 4 != 0)) for k in range(1500)]
    docs = spark.createDataFrame([(*r, "x", 0.0) for r in rows], "doc_id bigint, text string, row string, score double")
    labels = spark.createDataFrame([(k, int(k % 4 != 0)) for k in range(0, 1500, 2)] + [(None, 1), (3, None)], "doc_id bigint, quality int")
    got = quality(docs, labels).collect()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 != 0) for r in got]) > 0.98
    hidden = labels.filter((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    assert {tuple(r) for r in quality(docs, hidden).collect()} == {tuple(r) for r in got}  # held-out labels play no part


def test_quality_sample_is_bounded_under_a_hot_id(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr("cartlight.llm.quality.fit", lambda p, u: sizes.append((p.dtype, len(p), len(u))))
    hot = next(k for k in range(99) if zlib.crc32(str(k).encode()) % 5)
    rows = [(hot, f"text {k} of one id") for k in range(3000)] + [(hot, "the same")] * 2000 + [(None, "no id")] * 50
    docs = spark.createDataFrame([*rows, (100 + hot, "another")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(hot, 1)], "doc_id bigint, quality int")
    fit_quality(docs, labels, sample=10)
    fit_quality(docs, labels, sample=10_000)
    assert sizes == [(np.float32, 10, 10), (np.float32, 3001, 3003 - (zlib.crc32(str(100 + hot).encode()) % 5 == 0))]


def test_quality_without_labels_or_texts(spark):
    docs = data.documents(spark)
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r["score"] for r in quality(docs, none).collect()} == {0.5}
    labels = spark.createDataFrame([(k, 1) for k in range(101)], "doc_id bigint, quality int")
    assert len(quality(docs, labels).collect()) == docs.count()
    assert quality(data.empty_documents(spark), labels).collect() == []


def test_features_of_blocks_are_those_of_the_whole(monkeypatch):
    text = ("Word, after word!\n" * 300).encode()
    whole = features(text)
    monkeypatch.setattr("cartlight.llm.quality._BLOCK", 1000)
    assert np.allclose(features(text), whole) and np.isfinite(features(b"")).all() and np.isfinite(features(None)).all()


def test_risk_does_not_fall_below_zero():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(1, 1, (400, 3)), rng.normal(-2, 1, (400, 3))
    model = fit(good[:200], np.r_[good[200:], bad])
    assert 0.2 < model.prior < 0.5
    assert (model.score(good) >= 0.5).mean() > 0.9 and (model.score(bad) < 0.5).mean() > 0.9


PII = [
    "Write to Ann.Lee@Mail.example.com, ann.lee@mail.example.com or bob@x.org.", "Call +1 (469) 555-8958 or +1 469 555 8958!",
    "card 4532015112830366 and 4532-0151-1283-0366, host 10.0.0.1", "password = \"e3b3ed3cc8548923d6\" Maria Keller met MARIA",
    "Мария Иванова и Άννα, Juan Pérez; Peter Keller", None, "", "nothing 12 here", "1.2.3.4.5 version, 2024-01-02",
]


def test_surrogates_are_consistent_and_distinct(spark):
    rows = [(k, t, "x") for k, t in enumerate(PII)] + [(0, PII[0], "x"), (None, PII[0], "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, entities string")
    done = replace_pii(docs, b"key").collect()
    assert len(done) == len(rows)
    there, back = {}, {}
    for r in done:
        old = PII[r["doc_id"] or 0]
        found = find_entities(old or "")
        assert len(found) == len(r["entities"])
        if not found:
            assert r["text"] == old
        for (start, end, kind), e in zip(found, r["entities"]):
            mention, new = old[start:end], r["text"][e["start"] : e["end"]]
            value, made = canonical(kind, mention), canonical(kind, new)
            assert there.setdefault((kind, value), made) == made and back.setdefault((kind, made), value) == value
            assert [c.isdigit() for c in mention] == [c.isdigit() for c in new] or kind in ("ip", "given", "secret")
            assert kind == "given" or value != made
    assert there["email", "ann.lee@mail.example.com"].endswith(".com")
    lists = {n.casefold(): k for k, names in GIVEN_NAMES.items() for n in names}
    assert all(lists[v] == lists[m] for (k, v), m in there.items() if k == "given")
    assert len([1 for k, _ in there if k == "surname"]) == 3
    again = {(r["doc_id"], r["text"]) for r in replace_pii(docs, b"key").collect()}
    assert again == {(r["doc_id"], r["text"]) for r in done}
    assert again != {(r["doc_id"], r["text"]) for r in replace_pii(docs, b"other").collect()}
    assert replace_pii(data.empty_documents(spark), b"key").collect() == []


def test_collisions_draw_again(spark):
    values = [("ssn", f"{k:03d}") for k in range(400)]  # 1000 draws at most, 400 of them real
    table = surrogate_table(Scratch(spark, "test"), spark.createDataFrame(values, "kind string, value string"), b"key")
    made = [r["surrogate"] for r in table.collect()]
    assert len(set(made)) == 400 and not set(made) & {v for _, v in values}


def test_valid_card_numbers_stay_valid():
    made = surrogate(b"key", "card", "4532015112830366", 0)
    digits = [int(c) for c in made]
    total = sum(d if k % 2 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(digits))
    assert made[0] == "4" and total % 10 == 0
    assert render("card", "4532-0151-1283-0366", made) == "-".join(made[k : k + 4] for k in range(0, 16, 4))
