import math
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from quiverlake.llm import pieces as p

pytestmark = pytest.mark.skipif(not Path(p.MODEL_PATH).exists(), reason="public tokenizer files are not here")


@pytest.fixture(scope="module")
def model():
    return p.Pieces(p.load())


def test_round_trip_of_any_text(model):
    rng = random.Random(1)
    signs = "ab the▁ \n\té漢\u0000🙂́<0x0A><s> .,!9"
    for k in range(300):
        text = "".join(rng.choices(signs, k=rng.randint(0, 80)))
        assert model.decode(model.encode(text, k)) == text
    long = "x" * 5000 + "漢" * 3000
    assert model.decode(model.encode(long, 1)) == long


def every(model, unit):
    """All segmentations with their weights, by brute force."""
    if not unit:
        return {(): 1.0}
    out = {}
    for i in range(1, len(unit) + 1):
        if found := model.weight.get(unit[:i]):
            for rest, w in every(model, unit[i:]).items():
                out[(found[1], *rest)] = out.get((found[1], *rest), 0) + math.exp(found[0]) * w
    return out


@pytest.mark.parametrize("unit", [" the", " hello", "nation", " internationals", "a. b, c"])
def test_draws_follow_the_weights(model, unit):
    want = every(model, unit)
    total = sum(want.values())
    n = 20000
    ids, sizes = model.encode_all([unit] * n, list(range(n)))
    got = Counter(tuple(x.tolist()) for x in np.split(ids, np.cumsum(sizes)[:-1]))
    assert set(got) <= set(want)
    for seg, w in want.items():
        share = w / total
        assert abs(got[seg] / n - share) < 5 * (share * (1 - share) / n) ** 0.5 + 1e-3


def test_no_piece_crosses_a_cut(model):
    rng = random.Random(5)
    words = rng.sample(list(model.weight), 400)
    for _ in range(200):
        text = "".join(rng.choices(words, k=12))
        cut = model.cuts(p._points(text))
        for i in range(len(text)):
            for j in range(i + 1, min(len(text), i + model.longest) + 1):
                if text[i:j] in model.weight:
                    assert not cut[i + 1 : j].any()


def test_block_and_single_texts_agree(model):
    rng = random.Random(6)
    texts = ["".join(rng.choices("ab the▁ \n\té漢🙂.,", k=rng.randint(0, 60))) for _ in range(50)]
    ids, sizes = model.encode_all(texts, list(range(50)))
    parts = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert parts == [model.encode(t, k) for k, t in enumerate(texts)]


def test_rows_are_reproducible_and_lossless(spark):
    rows = [(i, t, 0) for i, t in enumerate(["one two three", "one two three", None, "", "a  b\n\n c ▁ d", "word " * 3000])] + [(0, "one two three", 1), (None, "x y", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pieces int")
    a = sorted(map(str, p.encode(docs.repartition(3)).collect()))
    assert a == sorted(map(str, p.encode(docs.coalesce(1)).collect()))
    assert len(a) == len(rows) and p.encode(docs).where("not lossless").count() == 0
    back = sorted((str(r["doc_id"]), str(r["text"])) for r in p.decode(p.encode(docs)).collect())
    assert back == sorted((str(i), str(t)) for i, t, _ in rows)
    long = spark.createDataFrame([(i, "several words of one text " * 20) for i in (0, 1, 1)], "doc_id long, text string")
    drawn = [(r["doc_id"], str(r["pieces"])) for r in p.encode(long).collect()]
    assert len(set(drawn)) == 2 and len({x for _, x in drawn}) == 2
    assert p.encode(docs.limit(0)).count() == 0


def test_block_bytes_change_no_result(spark):
    docs = spark.createDataFrame([(i, f"text {i} of a block, é漢 " * (1 + i % 9)) for i in range(50)] + [(60, None), (61, "")], "doc_id long, text string")
    assert sorted(map(str, p.encode(docs, most=100).collect())) == sorted(map(str, p.encode(docs).collect()))
