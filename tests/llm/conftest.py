import random
import zlib

import pytest

SYLLABLES = {"en": ["the", "ing", "and", "er", "wh"], "de": ["sch", "ung", "ein", "ver", "ü"], "fr": ["eau", "ion", "é", "qu", "oi"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n))


def fold(doc_id, mod):
    return zlib.crc32(str(doc_id).encode()) % mod


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents with labels: junk of label quality 0, insults of label toxic 1; plus nulls, empty and repeated rows, and clashing columns."""
    rng = random.Random(11)
    docs, labels = [], []
    for i in range(600):
        lang = rng.choice(list(SYLLABLES))
        text = prose(rng, lang, rng.randint(20, 120)) + "."
        quality, toxic = 1, 0
        if i % 7 == 0:
            quality = 0
            text = rng.choice([text.upper().replace(" ", "!! "), text.replace(" ", "### "), " | ".join(text.split())])
        elif i % 5 == 0:
            toxic = 1
            words = text.split()
            for w in rng.sample(["idiot", "moron", "clown", "zwackor", "zwackel", "zwackun"], 3):
                words.insert(rng.randrange(len(words)), w)
            text = " ".join(words)
        docs.append((i, text, lang, "s", len(text), "x", 1.0))
        labels.append((i, quality, toxic))
    docs += [(5000, None, None, None, None, "x", 1.0), (5001, "", "en", "s", 0, "x", 1.0), (5002, "12 34", "en", "s", 5, "x", 1.0), docs[3], (None, docs[4][1], "en", "s", 1, "x", 1.0)]
    docs.append((5003, "the and " * 20000, "en", "s", 1, "x", 1.0))
    labels += [(5001, None, None), (None, 1, 1), labels[3]]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, fp string, score double").repartition(5),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )
