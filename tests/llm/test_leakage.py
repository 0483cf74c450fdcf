import random

import pytest

from bidloom.llm.leakage import leaked_items
from bidloom.llm.text import edits, near, words

ITEM = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]


def brute(doc, item, window=15, most=2):
    w, best = words(doc), False
    for a in range(len(item) - window + 1):
        for b in range(len(w) - window + 1):
            same = [x == y for x, y in zip(item[a : a + window], w[b : b + window])]
            ends = all(same[k] or near(item[a + k], w[b + k]) for k in (0, window - 1))
            best = best or same.count(False) <= most and ends
    return best


def test_words():
    assert words("<p>Café <b>au</b> lait,&nbsp;faul-\ntless sign-off; SÃ©vérin’s 4,562</p>") == ["cafe", "au", "lait", "faultless", "signoff", "severins", "4562"]
    assert edits("abcd", "abdc", 2) == 1 and edits("abcdef", "xyz", 2) == 3 and near("supports", "supprts") and not near("cat", "dog")


def test_against_brute_force(spark):
    rng = random.Random(3)
    docs = []
    for i in range(120):
        n, a = rng.randrange(8, 40), rng.randrange(0, 20)
        part = ITEM[a : a + n]
        for _ in range(rng.randrange(0, 5)):
            part[rng.randrange(len(part))] = rng.choice(["other", "thing"])
        docs.append((i, "Intro text here. " + " ".join(part).upper() + ", and more text."))
    docs += [(500, None), (501, ""), (None, " ".join(ITEM)), (502, "x " * 200_000 + " ".join(ITEM[:20])), (503, " ".join(ITEM)), (503, " ".join(ITEM))]
    d = spark.createDataFrame([(*x, "junk") for x in docs], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(7, " ".join(ITEM)), (8, "too short"), (9, None), (None, " ".join(ITEM)), (10, " ".join(reversed(ITEM)))], "item_id long, item_text string")
    got = {(r.doc_id, r.item_id) for r in leaked_items(d, items).collect()}
    want = {(i, 7) for i, t in docs if i is not None and t and (i == 502 or brute(t, ITEM))}
    assert got == want


def test_repeated_shingles(spark):
    """A passage whose shingles repeat, one whose changed words leave four, and one id with two texts."""
    echo = "one two three four five six one two three four five six one two three four five six".split()
    changed = ITEM[10:30]
    changed[5] = changed[10] = "other"
    docs = [(1, "so: " + " ".join(echo[:15])), (2, " ".join(changed[1:16])), (3, " ".join(ITEM[40:58])), (4, " ".join(ITEM[:14]))]
    items = [(1, " ".join(echo)), (2, " ".join(ITEM[:40])), (2, " ".join(ITEM[40:])), (3, " ".join(ITEM[:40]))]
    got = leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string")).collect()
    assert {(r.doc_id, r.item_id, r.n_words, r.n_changed) for r in got} == {(1, 1, 15, 0), (2, 2, 15, 2), (2, 3, 15, 2), (3, 2, 18, 0)}


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, item_text string")
    assert leaked_items(d, items).count() == 0
    with pytest.raises(ValueError):
        leaked_items(d, items, window=8, mismatches=3)
