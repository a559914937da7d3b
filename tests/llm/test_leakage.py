import random

import pytest

from lexloom.llm import leakage as k

R = random.Random(3)
VOCABULARY = ["".join(R.choices("abcdefghijklmnoprstuvw", k=R.randint(3, 9))) for _ in range(3000)]


def prose(n, seed):
    r = random.Random(seed)
    return [r.choice(VOCABULARY) for _ in range(n)]


ITEM = prose(300, 1)
LICENCE = prose(60, 2)
BEFORE, AFTER = prose(100, 7), prose(100, 8)


def sentence(words):
    return " ".join(words)


def around(words):
    return sentence(BEFORE) + ". " + words + ". " + sentence(AFTER)


def altered(words, every=8):
    return [w if (j + 3) % every else "zzq" + w[::-1] for j, w in enumerate(words)]


PASSAGE = ITEM[100:150]
HELD = {
    1: around(sentence(PASSAGE)),
    2: around(sentence(PASSAGE).upper().replace(" ", ",\n  ")),
    3: around(sentence(altered(PASSAGE))),
    4: around("&lt;p&gt;" + "&lt;/p&gt;\n&lt;p&gt;".join(sentence(PASSAGE[j : j + 9]) for j in range(0, 50, 9)) + "&quot;"),
    5: around("\n" + "\n".join(f"{j + 1:3}  " + sentence(PASSAGE[j * 7 : j * 7 + 7]) for j in range(8)) + "\n"),
    6: around(sentence(PASSAGE).replace(" ", "\\n", 4)),
    7: sentence(ITEM[:30]),
    8: around(sentence(ITEM[200:226])),
}
FREE = {20: around(sentence(ITEM[100:118])), 21: around(sentence(LICENCE)), 22: around(""), 23: None, 24: "", 25: "word", 26: around(sentence(R.sample(PASSAGE, 50))), 27: around(sentence(ITEM[10:18]) + " and " + sentence(ITEM[60:70]))}


def frames(spark, documents):
    docs = spark.createDataFrame([(i, t, 0) for i, t in documents.items()], "doc_id long, text string, item_id long")
    items = spark.createDataFrame([(1, sentence(ITEM) + ". " + sentence(LICENCE), "a"), (2, sentence(LICENCE) + ". " + sentence(prose(200, 3)), "b"), (3, None, "c"), (4, "", "d"), (5, "short", "e")], "item_id long, text string, category string")
    return docs, items


def test_passages(spark):
    docs, items = frames(spark, HELD | FREE)
    got = {(r["doc_id"], r["item_id"]) for r in k.find(docs.unionByName(docs.limit(2)), items).collect()}
    assert got == {(i, 1) for i in HELD}


def test_slices_give_the_same(spark):
    docs, items = frames(spark, HELD | FREE)
    whole = sorted(map(tuple, k.find(docs, items).collect()))
    assert sorted(map(tuple, k.find(docs, items, slice_chars=700).collect())) == whole


def test_empty_tables(spark):
    docs, items = frames(spark, HELD)
    assert k.find(docs.limit(0), items).count() == 0
    assert k.find(docs, items.limit(0)).count() == 0


def test_very_long_document(spark):
    docs, items = frames(spark, {1: sentence(prose(300_000, 9)) + " " + sentence(PASSAGE) + " " + sentence(prose(300_000, 10))})
    assert [(r["doc_id"], r["item_id"]) for r in k.find(docs, items).collect()] == [(1, 1)]


@pytest.mark.parametrize("text", [None, "", "A&amp;amp;B", "\\u0041\\nb"])
def test_normal_form(text):
    assert k.normal(text) == {None: "", "": "", "A&amp;amp;B": "a&b", "\\u0041\\nb": "a b"}[text]


def test_long_runs_of_one_character():
    for c in ("\\", "&", "<a ", "1 \n", "-"):
        assert k.holds([c * 200_000], k.Items([1], [sentence(ITEM)], set())) == []


def passages(lo, hi, n_words, alter, n=60):
    """Documents that each hold ``n_words`` random words of one of n items, one word in eight altered; words of lo to hi characters."""
    r = random.Random(lo * 100 + hi)
    word = lambda: "".join(r.choices("abcdefghijklmnoprstuvw0123456789", k=r.randint(lo, hi)))
    items = [" ".join(word() for _ in range(400)) for _ in range(n)]
    docs = []
    for x in items:
        at = r.randint(0, 400 - n_words)
        held = x.split()[at : at + n_words]
        if alter:
            held = [w if (j + 3) % 8 else word() + "q" for j, w in enumerate(held)]
        docs.append(" ".join([*(word() for _ in range(150)), *held, *(word() for _ in range(150))]))
    return items, docs


@pytest.mark.parametrize("n_words, alter", [(25, False), (25, True), (30, True)])
@pytest.mark.parametrize("lo, hi", [(1, 1), (1, 2), (1, 3), (2, 4), (3, 9)])
def test_recall_by_length_of_words(lo, hi, n_words, alter):
    items, docs = passages(lo, hi, n_words, alter)
    found = {(t, i) for t, i, _ in k.holds(docs, k.Items(list(range(len(items))), items, set()))}
    assert sum((i, i) in found for i in range(len(items))) >= 0.95 * len(items) and all(t == i for t, i in found)


def test_idioms_of_several_items_are_no_loss():
    r = random.Random(5)
    idioms = [" ".join(r.sample(VOCABULARY, 7)) for _ in range(40)]
    items = [" ".join(r.choice(idioms) for _ in range(60)) for _ in range(20)]
    docs = [around(" ".join(x.split()[70:110])) for x in items]
    found = {(t, i) for t, i, _ in k.holds(docs, k.Items(list(range(20)), items, set()))}
    assert all((i, i) in found for i in range(20))


def test_repeated_items_stay_bounded():
    item = "x y z " * 5000 + sentence(ITEM)
    made = k.Items([1], [item], set())
    assert all(len(i.place) < 20_000 for i in made.indexes)
    assert [i for _, i, _ in k.holds([around(sentence(PASSAGE)), "a b c d e f g"], made)] == [0]
