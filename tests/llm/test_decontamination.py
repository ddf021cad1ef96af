import random

import regex

from quiverlake.llm import decontamination as d

ITEM = "A farmer sells 12 kg of apples to Maria for 30 dollars. How much does Maria pay for 4 kg of apples on the same day?"


def run(spark, docs, items):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, h string, windows int")
    items = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, raw string")
    return {(r["doc_id"], r["item_id"]): r for r in d.matches(docs, items).collect()}


def test_copies_and_new_parameters_are_found(spark):
    changed = ITEM.replace("Maria", "Peter").replace("12 kg", "7 lb").replace("30 dollars", "18 euros").replace("4 kg", "3 lb")
    mixed = ITEM.replace("to Maria", "to Peter").replace("does Maria", "does Anna")
    docs = [(1, "Some words before it. " + ITEM + " And after."), (2, "x " + changed), (3, "A farmer sells apples to Maria. How much does she pay?"), (4, None), (5, ""), (6, ITEM.upper().replace("MARIA", "Maria")), (7, mixed), (None, ITEM)]
    got = run(spark, docs, [(10, ITEM), (11, None), (12, "  "), (13, ITEM)])
    assert {k[0] for k in got} == {1, 2, 6, 7, None} and {k[1] for k in got} == {10, 13}
    assert got[1, 10]["changed"] == 0 and got[1, 10]["consistency"] == 1
    assert got[2, 10]["changed"] >= 5 and got[2, 10]["consistency"] == 1
    assert got[7, 10]["consistency"] < 1


def test_inconsistent_slots_are_rejected(spark):
    item = "so 5 and 5 but 5 or 5 yet 5 for 5 nor 5 thus 5 hence 5 once"
    other = "so 1 and 2 but 3 or 4 yet 6 for 7 nor 8 thus 9 hence 0 once"
    same = item.replace("5", "8")
    assert set(run(spark, [(1, other), (2, same)], [(0, item)])) == {(2, 0)}


def test_one_consistent_alignment_is_enough(spark):
    numbers = "What is the next number in the sequence 2, 4, 6, 8, 10, 12, 14, 16, 18, 20?"
    variants = [ITEM.replace("Maria", n).replace("12", str(k)).replace("30", str(k + 1)).replace("4 kg", f"{k + 2} lb") for n, k in (("Peter", 51), ("Anna", 71))]
    docs = [(1, "Before it. " + numbers), (2, " Then ".join([variants[0], ITEM, variants[1]])), (3, variants[0]), (3, ITEM), (3, variants[1]), (4, numbers.replace("number in", "whole number in"))]
    got = run(spark, docs, [(0, numbers), (1, ITEM)])
    assert {(1, 0), (2, 1), (3, 1)} <= set(got) <= {(1, 0), (2, 1), (3, 1), (4, 0)}
    assert all(got[k]["consistency"] == 1 and got[k]["changed"] == 0 for k in ((1, 0), (2, 1), (3, 1)))


def test_copies_in_other_case_or_wrapped_anew_are_found(spark):
    wrapped = ITEM.replace(" Maria", "\nMaria")
    docs = [(1, ITEM.lower()), (2, ITEM.upper()), (3, wrapped), (4, ITEM.replace(" Maria", "  Maria")), (5, "so " + ITEM.replace("12 kg", "7\nkg").lower())]
    got = run(spark, docs, [(0, ITEM)])
    assert set(got) == {(i, 0) for i in range(1, 6)}
    assert all(r["similarity"] == 1 for r in got.values())


def test_short_items_and_empty_tables(spark):
    assert set(run(spark, [(1, "three short words"), (2, "three short words more")], [(0, "Three short words!")])) == {(1, 0)}
    assert run(spark, [], [(0, ITEM)]) == {} and run(spark, [(1, ITEM)], []) == {}


def test_join_without_broadcast_gives_the_same(spark, monkeypatch):
    docs = [(i, ITEM.replace("12", str(i))) for i in range(20)] + [(99, "nothing of it")]
    small = run(spark, docs, [(0, ITEM)])
    monkeypatch.setattr(d, "BROADCAST_ROWS", 0)
    assert run(spark, docs, [(0, ITEM)]) == small and len(small) == 20


def test_clean_keeps_columns(spark):
    docs = spark.createDataFrame([(1, ITEM, "a"), (2, "other", "b")], "doc_id long, text string, h string")
    items = spark.createDataFrame([(0, ITEM)], "item_id long, text string")
    assert d.clean(docs, items).collect() == [(2, "other", "b")]


def test_several_changed_copies_and_items_without_id(spark):
    variants = [ITEM.replace("Maria", n).replace("12", str(k)).replace("30", str(k + 1)).replace("4 kg", f"{k + 2} lb") for n, k in (("Peter", 51), ("Anna", 71), ("Otto", 91))]
    docs = [(1, " Then ".join(variants)), (2, " Then ".join([ITEM, *variants])), (3, ITEM), (3, ITEM), (4, "word " * 20_000 + ITEM + " word" * 20_000), (5, "nothing " * 50)]
    got = run(spark, docs, [(None, ITEM), (1, "quite another item of seven words here")])
    assert set(got) == {(i, None) for i in (1, 2, 3, 4)}
    assert all(got[i, None]["consistency"] == 1 for i in (2, 3, 4)) and got[1, None]["consistency"] >= d.CONSISTENCY


def test_holders_column_of_the_input_is_no_clash(spark):
    docs = spark.createDataFrame([(1, ITEM, "a", 1), (2, "other", "b", 2)], "doc_id long, text string, holder string, _holder int")
    assert d.clean(docs, spark.createDataFrame([(0, ITEM)], "item_id long, text string")).collect() == [(2, "other", "b", 2)]


def plain_windows(text, named):
    """The template windows of a text by plain string code: word for word, without hashes."""
    out = regex.sub(r"(?<!\S)([^\s\p{L}0-9]{0,4})[0-9]\S*", lambda m: m[1] + "\x01", text or "")
    out = regex.sub(rf"(?i)\x01(\s+)(?:{d.UNITS})(?![\p{{L}}0-9])", lambda m: "\x01" + m[1] + "\x02", out)
    out = regex.sub(r"(?<=[^\s.!?:;][ \t])\p{Lu}\p{Ll}[\p{L}'’-]*", lambda m: "\x03" + m[0], out)
    words = [w for w in regex.split(r"\s", regex.sub(d.PUNCTUATION, "", out.lower())) if w]
    words = [(w if w[0] != "\x03" else "\x03" if named else w[1:]) for w in words]
    return {tuple(words[i : i + d.WINDOW]) for i in range(max(len(words) - d.WINDOW + 1, min(len(words), 1)))}


def test_similarity_against_plain_windows(spark):
    rng = random.Random(12)
    words = "the farm has Maria 12 kg and apples, 7 on. Then Otto paid (30 dollars) for it; so 3 miles away".split()
    items = [(i, " ".join(rng.choices(words, k=rng.randint(3, 30)))) for i in range(25)]
    docs = []
    for i in range(120):
        own = rng.choice(items)[1].split()
        for _ in range(rng.randint(0, 2)):
            own[rng.randrange(len(own))] = rng.choice(words)
        docs.append((i, rng.choice([" ", "  ", "\n"]).join(rng.choices(words, k=rng.randint(0, 8)) + own + rng.choices(words, k=rng.randint(0, 8)))))
    got = run(spark, docs, items)
    for i, text in docs:
        for j, item in items:
            best = 0.0
            for named in (True, False):
                have, want = plain_windows(text, named), plain_windows(item, named)
                best = max(best, len(have & want) / len(want))
            if (i, j) in got:
                assert abs(got[i, j]["similarity"] - best) < 1e-12 and best >= d.SIMILARITY
            elif item in " ".join(text.split()):
                raise AssertionError((text, item))
            else:
                # what is similar enough and not reported has slots that no alignment makes consistent
                assert best < d.SIMILARITY or regex.search(r"[0-9]|\p{Lu}", item)
