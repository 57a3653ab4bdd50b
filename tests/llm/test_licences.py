"""Whole texts of the longer licences, and copyright lines that name the owner first."""

from __future__ import annotations

import os

import pytest

from cartlight.llm.licence_scan import licence_scan
from cartlight.llm.licences import KNOWN

FOLDER = "/usr/share/common-licenses"


def _found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return [r["licence"] for r in licence_scan(docs).orderBy("doc_id").collect()]


def test_owner_lines(spark):
    whole = KNOWN[0][1]
    lines = ["Copyright Jane Doe 2020", "Copyright Google LLC", "copyright by Some One, 1999-2004", "Copyright (c) 2020 A"]
    assert _found(spark, [f"{line}\n{whole}" for line in lines]) == ["MIT"] * 4
    others = ["Copyright License", "Copyright holders may do more"]
    assert _found(spark, [f"{line}\n{whole}" for line in others]) == [None, None]
    assert _found(spark, [text for _, text in KNOWN]) == [name for name, _ in KNOWN]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no licence texts here")
def test_whole_texts(spark):
    names = {
        "Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only",
        "LGPL-3": "LGPL-3.0-only", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3-only",
    }
    texts = [open(f"{FOLDER}/{name}", encoding="utf-8").read() for name in names]
    assert _found(spark, texts) == list(names.values())
    assert _found(spark, [t.replace("[yyyy] [name of copyright owner]", "2020 A") for t in texts[:1]]) == ["Apache-2.0"]
    assert _found(spark, [t + " and more" for t in texts]) == [None] * len(texts)
