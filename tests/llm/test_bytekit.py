import numpy as np
import pyarrow as pa

from quiverlake.llm.bytekit import PRIME, Block, fold31
from quiverlake.llm.quality_rules import base_columns


def spans(block):
    return block.span_hash(block.starts, block.ends)


def test_equal_contents_have_equal_hashes():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abé"), rng.integers(0, 30))) for _ in range(400)]
    hashes = spans(Block(pa.array(texts + texts)))
    assert (hashes[:400] == hashes[400:]).all()
    assert len(set(hashes.tolist())) == len(set(texts))


def test_words_built_to_collide_do_not():
    bits = [0]
    while len(bits) < 4096:
        bits += [1 - b for b in bits]
    for n in (1024, 2048, 4096):
        a, b = "".join("ab"[x] for x in bits[:n]), "".join("ba"[x] for x in bits[:n])
        block = Block(pa.array([a + "\n" + b, a, b]))
        assert len(set(spans(block).tolist())) == 3
        assert base_columns(block)["n_dup_lines"].tolist() == [0, 0, 0]


def test_fold31():
    x = np.array([0, 1, 2**31 - 1, 2**31, 2**62 - 1, 2**63 - 1], np.uint64)
    assert [int(v) % int(PRIME) for v in x] == fold31(x).tolist()
