"""Personal data by hand-labelled spans: [[kind:mention]] marks what must be found, and nothing else may be."""

from __future__ import annotations

import random
import re

import pytest

from cartlight.llm.pii import _MAYBE, _NAME_KEYS, canonical, find_entities, render, replace_pii, surrogate, surrogate_table
from cartlight.llm.scratch import Scratch

LABELLED = [
    "access_token=[[secret:abc123def456]]",
    "client_secret: [[secret:abcdefgh12]], next",
    "export DB_PASSWORD=[[secret:hunter2hunter]]",
    "secret_key = [[secret:abcdefgh+/12==]]",
    '{"password": "[[secret:abc!def,ghi jkl]]", "user": "x"}',
    "{'api-key': '[[secret:k;:e-y_12345]]'}",
    'config["accessToken"] = "[[secret:abcdefgh]]"',
    'in a string \\"password\\": \\"[[secret:abcdefgh1]]\\"',
    "password=[[secret:abc!defghijkl]]",
    "see /x?access_token=[[secret:abcdef1234]]&user=5",
    "Password=[[secret:abc12345]];User Id=sa;",
    "tokenizer: google/bert-base, secretary: Somebody Else, password: ********, secret ----------",
    "call [[phone:469-555-8958]] or [[phone:469.555.8958]], [[phone:1-469-555-8958]]; [[phone:(469)555-8958]].",
    "[[phone:469 555 8958]] and [[phone:0049 30 1234567]], not 100 200 3000 or 2024-01-02 or 1.2.469-555-8958",
    "[[given:MARIA]] [[surname:KELLER]] met [[given:Mary]] [[surname:O'Brien]]",
    "[[given:Anna]] [[surname:Schmidt-Meier]]'s, [[given:Mary]] J. [[surname:Blige]], [[given:Mary]] [[surname:Keller]]'s",
    "[[given:John]] [[surname:D’Angelo]] and [[given:ΜΑΡΙΑ]], [[given:ΝΙΚΟΣ]]; [[given:ПЕТР]], to be frank, maria",
    "card [[card:3782 822463 10005]]",
    "number [[phone:+12345]] only",
]


def _labels(text):
    plain, spans, at = "", [], 0
    for m in re.finditer(r"\[\[(\w+):(.*?)\]\]", text):
        plain += text[at : m.start()]
        spans.append((len(plain), len(plain) + len(m.group(2)), m.group(1)))
        plain, at = plain + m.group(2), m.end()
    return plain + text[at:], spans


@pytest.mark.parametrize("text", LABELLED)
def test_labelled_spans(text):
    plain, spans = _labels(text)
    assert find_entities(plain) == spans


def test_a_text_with_an_entity_is_never_passed_over(spark):
    """Spark's pattern for texts to look at holds for every text in which something is found."""
    rng = random.Random(3)
    alone = [plain[a:b] for plain, spans in map(_labels, LABELLED) for a, b, k in spans if k != "secret"]
    texts = [_labels(t)[0] for t in LABELLED] + alone
    texts += [chr(c) + low[1:] for low in _NAME_KEYS for c in range(0x2200) if chr(c).lower() == low[0]]
    texts += [
        low[0].upper() + low[1:k] + chr(c) + low[k + 1 :]
        for low in _NAME_KEYS for k in range(1, len(low)) for c in (*range(0x80), *range(0x17F, 0x180), *range(0x370, 0x460), 0x212A)
        if chr(c).lower() == low[k]
    ]
    texts += ["+12345", "+1 23 45", "1.2.3.4", "１２３-４５-６７８９", "x٤٦٩-٥٥٥-٨٩٥٨", "٤٦٩-٥٥٥-٨٩٥٨"]
    pieces = ["469", "555", "8958", "-", ".", " ", "(", ")", "+", "00", "1", "Maria", "ANNA", "token", "Api Key", "Pwd", "=", ": ", '"', "abcdefgh9", "_", "x", "\n"]
    texts += ["".join(rng.choices(pieces, k=rng.randint(2, 9))) for _ in range(20000)]
    found = [(t,) for t in dict.fromkeys(texts) if find_entities(t)]
    assert len(found) > 3000
    missed = spark.createDataFrame(found, "text string").filter(f"not rlike(text, {_quoted(_MAYBE)})").collect()
    assert missed == []


def _quoted(pattern):
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def test_one_number_in_several_forms_has_one_surrogate(spark):
    forms = ["+1 (469) 555-8958", "469.555.8958", "1-469-555-8958", "+49 30 1234567", "0049 30 1234567", "MARIA", "Maria"]
    docs = spark.createDataFrame(list(enumerate(forms)), "doc_id bigint, text string")
    made = [r["text"] for r in replace_pii(docs, b"key").orderBy("doc_id").collect()]
    kinds = [find_entities(t)[0][2] for t in forms]
    values = [canonical(k, t) for k, t in zip(kinds, made)]
    assert values[0] == values[1] == values[2] != canonical("phone", forms[0])
    assert values[3] == values[4] and made[4].startswith("0049 ") and made[3].startswith("+49 ")
    assert made[5] == made[6].upper() and made[6] != "Maria"
    assert all([c for c in a if not c.isalnum()] == [c for c in b if not c.isalnum()] for a, b in zip(forms, made))


def test_short_surnames_and_secrets_of_signs_do_not_run_out(spark):
    names = [("surname", a + b) for a in "aeiou" for b in "bcdfghklmnprstvw"]  # all there are of this form
    signs = [("secret", "!!!!!!!" + c) for c in "abcdefghijklmnopqrstuvwxyz"]
    table = surrogate_table(Scratch(spark, "test"), spark.createDataFrame(names + signs, "kind string, value string"), b"key")
    made = [(r["kind"], r["surrogate"]) for r in table.collect()]
    assert len(set(made)) == len(names + signs) and not set(made) & set(names + signs)
    assert render("surname", "IS", "ufa") == "UFA" and render("surname", "Is", "ufa") == "Ufa"
    assert re.fullmatch(r"1[2-9]\d\d[2-9]\d{6}", surrogate(b"key", "phone", "14695558958", 0))
