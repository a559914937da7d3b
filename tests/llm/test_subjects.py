import random

import pytest

from lexloom.llm import subjects as s

R = random.Random(11)
NAMES = ["cooking", "law", "mathematics", "software"]
TOPIC = {"cooking": "flour oven sauce onion garlic pastry broth skillet".split(), "law": "court appeal statute verdict tribunal clause petition trial".split(), "mathematics": "theorem polynomial integer lemma proof matrix quotient axiom".split(), "software": "compiler parser thread kernel cache bytecode daemon runtime".split()}
PLAIN = "the a near between window village table measures reaches slowly often answer morning letter bridge corner".split()


def sentence(topic):
    return " ".join(R.choice(TOPIC[topic]) if k % 4 == 1 else R.choice(PLAIN) for k in range(13)).capitalize() + "."


def text(*parts):
    return "\n".join(" ".join(sentence(t) for _ in range(n)) for t, n in parts)


def code(names):
    return "\n".join(f"def {R.choice(names)}_step(value):\n    return {R.choice(names)}(value, {R.randint(1, 99)});" for _ in range(12))


DOCS, LABELS = [], []
for _i in range(300):
    _t = NAMES[_i % 4]
    DOCS.append((_i, text((_t, 8)) if _i % 8 != 3 else code(["bucket", "widget", "anchor"])))
    LABELS.append((_i, {"law": "legal ", "cooking": "Cooking"}.get(_t, _t) if _i % 5 == 0 else _t))
for _i in range(300, 340):
    DOCS.append((_i, code(["eigen", "gradient", "jacobian"])))
    LABELS += [(_i, "software"), (_i, "mathematics")]
TEST = {1000: text(("law", 6)), 1001: text(("law", 5), ("cooking", 5)), 1002: text(("law", 9), ("cooking", 1)), 1003: code(["bucket", "widget"]), 1004: code(["gradient", "jacobian"]), 1005: f"<html><body><p>{text(('cooking', 6))}</p></body></html>", 1006: None, 1007: "", 1008: " \n", 1009: "?!", 1010: "<div><span></span></div>"}
EXPECTED = {(1000, "law"), (1001, "law"), (1001, "cooking"), (1002, "law"), (1003, "software"), (1004, "software"), (1004, "mathematics"), (1005, "cooking")}


def frames(spark):
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t in [*DOCS, *TEST.items(), (1000, TEST[1000])]], "doc_id long, text string, subject string, share double")
    labels = spark.createDataFrame([*LABELS, *LABELS[:20], (None, "law"), (7, None), (99_999, "law")], "doc_id long, subject string")
    return docs, labels, spark.createDataFrame([(n,) for n in NAMES] + [(None,)], "subject string")


def test_subjects(spark):
    found = [tuple(r) for r in s.find(*frames(spark)).where("doc_id >= 1000").collect()]
    assert len(found) == len(EXPECTED) and set(found) == EXPECTED


@pytest.fixture(scope="module")
def model():
    return s.train(NAMES, [t for _, t in DOCS], [{x for j, x in LABELS if j == i} for i, _ in DOCS])[0]


def test_held_out_agreement(model):
    assert set(model.agreement) == set(NAMES) and min(model.agreement.values()) > 0.9


@pytest.mark.parametrize(
    "subject, text",
    [
        ("cooking", "# Onion pastry\n\n| what | how much |\n|---|---|\n| flour | 200 g |\n| onion | 3 |\n| broth | 1 l |\n\n1. Fill the skillet with onion.\n2. Pastry in the oven (200 C).\n"),
        ("cooking", "title: onion pastry\nlist:\n  - onion: 500 g\n  - garlic: 2\n  - broth: 1 l\n  - flour: 2\nsteps:\n  - skillet: onion, garlic\n  - oven: 200\n"),
        ("law", "State v. Miller, 45 P.2d 67 (appeal denied, court of 1988);\nIn re Adams, 7 U.S.C. 12(b)(6), tribunal statute [1990];\nRoe v. Doe, 3 A.C. 44 (verdict, trial = 12);\n"),
    ],
)
def test_signs_alone_are_no_code(model, subject, text):
    found = {model.names[k]: x for k, x in enumerate(model.shares([text])[0]) if x >= s.ACCEPT}
    assert subject in found and "software" not in found


def test_no_batch_size_matters(model):
    texts = [t for _, t in DOCS[:60]]
    assert abs(model.shares(texts) - s.np.concatenate([model.shares([t]) for t in texts])).max() < 1e-6


def test_sample_is_bounded_by_characters(spark):
    docs, labels, _ = frames(spark)
    texts, _ = s.sample_of(s.labelled_rows(docs, labels), 100, 9000)
    assert texts and sum(map(len, texts)) <= 9000


def test_a_smaller_sample_gives_the_same_subjects(spark):
    found = {tuple(r) for r in s.find(*frames(spark), max_labelled=220).where("doc_id >= 1000").collect()}
    assert found == EXPECTED


@pytest.mark.parametrize("empty", [0, 1, 2])
def test_empty_tables(spark, empty):
    f = list(frames(spark))
    f[empty] = f[empty].limit(0)
    assert s.find(*f).count() == 0


def test_all_labelled_documents_teach_forms_and_thresholds(spark):
    # the 2,000 first documents by the hash of their id have neither code nor mathematics
    ids = [r["id"] for r in spark.range(2400).selectExpr("id", "xxhash64(id) AS h").orderBy("h").collect()]
    docs, labels = [], []
    for k, i in enumerate(ids):
        topic = NAMES[k % 2] if k < 2200 else "software"
        docs.append((i, text((topic, 2)) if k < 2200 else code(["eigen", "gradient", "jacobian"] if k % 2 else ["bucket", "widget", "anchor"])))
        labels += [(i, topic)] + [(i, "mathematics")] * (k >= 2200 and k % 2)
    tests = {5000: code(["bucket", "widget"]), 5001: code(["gradient", "jacobian"]), 5002: text(("law", 6))}
    docs = spark.createDataFrame([*docs, *tests.items()], "doc_id long, text string")
    found = {tuple(r) for r in s.find(docs, spark.createDataFrame(labels, "doc_id long, subject string"), frames(spark)[2]).where("doc_id >= 5000").collect()}
    assert found == {(5000, "software"), (5001, "software"), (5001, "mathematics"), (5002, "law")}


def test_executors_count_what_one_pass_over_all_texts_counts(spark, model):
    docs, labels, _ = frames(spark)
    rows = s.labelled_rows(docs, labels).withColumn("held", s.F.expr("pmod(h, 5) = 4")).repartition(5).cache()
    part, whole, _ = s.trained(rows, NAMES)
    assert part.forms.known and (part.forms.words == model.forms.words).all() and abs(part.forms.shape_gain - model.forms.shape_gain).max() < 1e-5
    held = [r for r in rows.collect() if r["held"]]
    told = part.told([r["text"] for r in held])
    wanted = s.np.array([[any(s.folded(x) == n or (n, s.folded(x)) == ("law", "legal") for x in r["spellings"]) for n in NAMES] for r in held])
    s._calibrate(model, s._tallies(part, told, wanted, s.np.ones(len(held), bool)))
    assert (model.prose_least == part.prose_least).all() and (model.code_least == part.code_least).all() and (whole.prose_least == part.prose_least).all()


def test_shapes_of_a_text_do_not_depend_on_the_text_before():
    texts = ["a = f(1);", "", "One two.", "x"]
    alone = [s.Sentences([t]).tokens for t in texts]
    assert (s.Sentences(texts).tokens == s.np.concatenate(alone)).all()


def test_two_words_known_from_code_are_no_code(model):
    assert not model.shares(["bucket widget"]).any() and model.shares(["bucket(widget);"]).any()
