import random

import numpy as np
import pytest

from quiverlake.llm import pii


def brute(text):
    found = []
    for kind, pattern in (("email", pii.EMAIL), ("ip", pii.IP), ("card", pii.CARD), ("phone", pii.PHONE)):
        for m in pattern.finditer(text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
                if not 14 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            found.append((kind, *m.span()))
    return sorted(found, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@pytest.mark.parametrize("seed", range(20))
def test_base_spans_equal_plain_scans(seed):
    rng = random.Random(seed)
    parts = ["a", "b.c", "@", "x@y.z", ".", "1", "4", "4111 1111 1111 1111", "4111111111111111", "10.0.0.1", "256.1.1.1", "+1 (625) 555-7196", "-", " ", "é", "+", "%", "\n", "٣", "0007.0.0.1"]
    for _ in range(400):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert pii.base_spans(text) == brute(text), text


def test_trees_learn_and_base_spans_stay(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        key = "".join(rng.choices("0123456789abcdef", k=18))
        text = [f"one two password={key} three", f"call +1 (625) 555-{rng.randint(1000, 9999)} now", f"file {key}x{key} open", f"ip 10.{i % 250}.3.4 and 1{i}.300.1.1", f"é mail u{i}@a.example.com"][i % 5]
        rows.append((i, text, "z"))
    rows += [(1000, None, "z"), (1001, "", "z"), (None, "x@y.zz", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {r["doc_id"]: r for r in pii.find(docs).collect()}
    assert len(got) == len(rows)
    assert "secret:17:35" in got[0]["spans"] and got[0]["n_added"] == 1
    assert got[4]["n_email"] == 1 and got[4]["spans"] == "email:7:23"
    assert "secret" not in got[2]["spans"]
    assert got[1000]["spans"] == got[1001]["spans"] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert clean[0] == "one two password=<SECRET> three" and clean[1000] is None


def test_generators_propose_disguised_spans():
    rng = random.Random(7)
    spans = [("email", f"u{rng.randint(1, 99)}.x@mail{i}.example.com") for i in range(50)] + [("ip", f"{rng.randint(1, 255)}.{i}.3.44") for i in range(50)]
    spans += [("phone", f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}") for _ in range(50)] + [("phone", f"+49 30 {rng.randint(1000000, 9999999)}") for _ in range(50)]
    seen = []
    for kind, s in spans:
        for choice in range(len(pii.DISGUISES)):
            other, _ = pii.hidden(kind, s, "", choice)
            text = f"words before {other} and after"
            at = text.index(other)
            seen.append((kind, at, at + len(other)) in pii.candidates(text))
    assert np.mean(seen) >= 0.9, np.mean(seen)
    for value in ("hunter2", "Abc-123!xyz$", "k" * 500 + "7"):
        for text in (f'my password = "{value}" here', f"api_key:{value}", f"x PASSWORD=>'{value}'"):
            assert ("secret", text.index(value), text.index(value) + len(value)) in pii.candidates(text)


def test_marks_are_hidden_from_the_trees():
    text = "mail u1@a.example.com call +1 (625) 555-7196 at 10.2.3.4 with token = 'abcdef123456789' and version 10.2.300.4 or id 1234567890123456"
    rows = list(pii.examples(text))
    plus, at = [r for r, y in rows if y and r[0] == 3], [r for r, y in rows if y and r[0] == 0]
    assert plus and all(r[9] == 0 for r in plus) and at
    named = [r[15] for r, y in rows if y and r[0] == 4]
    assert sorted(named) == [0.0, 1.0]
    assert any(r[0] == 1 and y == 0 for r, y in rows) and any(r[0] == 2 and y == 0 for r, y in rows)


def test_repeated_rows_empty_tables_and_long_texts(spark):
    text = "word " * 200_000 + "u1@a.example.com " + "x" * 300_000 + " +1 (625) 555-7196"
    docs = spark.createDataFrame([(1, text), (1, text), (2, text[:5])], "doc_id long, text string")
    got = [tuple(r) for r in pii.find(docs).collect()]
    assert len(got) == 3 and got.count(next(r for r in got if r[0] == 1)) == 2
    assert [r[1] + r[4] for r in got if r[0] == 1] == [2, 2]
    none = docs.limit(0)
    assert pii.find(none).count() == 0 and pii.redact(none).columns == docs.columns


def test_calibration_without_candidates():
    trees = pii.calibrated(pii.boost(np.zeros((0, 21)), np.zeros(0)), np.zeros((0, 21)), np.zeros(0))
    assert set(trees.thresholds.values()) == {2.0}
