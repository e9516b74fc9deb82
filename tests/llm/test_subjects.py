import numpy as np
from pyspark.sql import functions as F

from tests.llm.conftest import CLASHING
from turnloom.llm.subjects import Chain, fold, sentences, subject_areas, subject_report

NOUNS = {"sea": "harbour anchor tide sailor lighthouse wave rudder mast".split(), "farm": "barn tractor cow harvest fence plough meadow hen".split(), "code": "compiler server patch login thread cache database script".split()}
SHAPES = ("The {} was near the {} once more.", "There is a {} but no {} at all.", "What about the {}, is it like the {}?", "They replaced the {}; the {} stays as it is.")
FILLER = ("Thanks, that is all for today.", "Please keep the number at hand.", "We had talked about it on Monday.", "This is answered below.")


def about(rng, subject, words):
    return SHAPES[rng.integers(0, len(SHAPES))].format(*rng.choice(words, 2))


def tables(spark, rng, n=150):
    examples = []
    for s, words in NOUNS.items():
        for _ in range(20):
            body = [about(rng, s, words[:5]) for _ in range(4)] + list(rng.choice(FILLER, 2))
            examples.append((len(examples), " ".join(body), "en", s if len(examples) % 5 else f" {s.upper()}"))
    examples += [(900, None, None, "sea"), (901, "x", None, None), (902, "y", None, "elsewhere")]
    documents, truth = [], {}
    for i in range(n):
        mains = list(rng.choice(list(NOUNS), int(rng.integers(0, 3)), replace=False))
        body = [about(rng, s, NOUNS[s]) for s in mains for _ in range(4)] + list(rng.choice(FILLER, 3))
        rest = [s for s in NOUNS if s not in mains]
        if mains and i % 2 and len(body) > 6:
            body.append(about(rng, rest[0], NOUNS[rest[0]]))
        rng.shuffle(body)
        documents.append((i, "\n".join(body) if i % 3 else " ".join(body)))
        truth[i] = set(mains)
    return spark.createDataFrame(examples, "example_id int, text string, lang string, subject string"), spark.createDataFrame([(s, s) for s in NOUNS], "subject string, description string"), documents, truth


def test_subjects_of_documents(spark):
    rng = np.random.default_rng(8)
    examples, areas, documents, truth = tables(spark, rng)
    long = " ".join(about(rng, "sea", NOUNS["sea"]) for _ in range(3000))
    rows = documents + [(1000, None), (1001, ""), (1002, " \n "), (1003, documents[0][1]), (1004, long), (1005, "..!"), (1006, "你好")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASHING})
    got = {i: set() for i, _ in rows}
    for r in subject_areas(df, examples, areas).collect():
        assert r["subject"] not in got[r["doc_id"]]
        got[r["doc_id"]].add(r["subject"])
    right = sum(got[i] == s for i, s in truth.items())
    assert right >= 0.95 * len(truth)
    assert got[1000] == got[1001] == got[1002] == got[1005] == got[1006] == set() and got[1003] == got[0] and got[1004] == {"sea"}


def test_empty_tables(spark):
    rng = np.random.default_rng(9)
    examples, areas, documents, _ = tables(spark, rng, 5)
    df = spark.createDataFrame(documents, "doc_id long, text string")
    assert subject_areas(df.limit(0), examples, areas).collect() == []
    assert subject_areas(df, examples.limit(0), areas).collect() == []


def test_sentences():
    text = "user: First one. Second… half!​Third?\n2. - Fourth\r\n[system] Fifth."
    assert [(" ".join(w), e) for w, e in sentences(text)] == [("first one", True), ("second half", True), ("third", True), ("fourth", False), ("fifth", True)]
    assert fold("Béfóré STRASSE ß") == "before strasse ss"


def test_chain_learns_co_occurrence():
    rng = np.random.default_rng(10)
    labels = np.column_stack([rng.random(3000) < 0.5, np.zeros(3000, dtype=bool)])
    labels[:, 1] = labels[:, 0]  # the second label always comes with the first
    share = np.column_stack([np.where(labels[:, 0], 0.4, 0.05) + rng.normal(0, 0.01, 3000), rng.random(3000)])
    features = np.column_stack([share, share, np.full(3000, 2.0), np.zeros(3000), np.zeros(3000)])
    rates = np.full((3000, 2), 0.5)
    found = Chain.fit(features, rates, labels).decode(features, rates)
    assert (found == labels).mean() > 0.99 > 0.8 > ((share >= 0.2) == labels).mean()


def test_chain_uses_sources():
    rng = np.random.default_rng(11)
    labels = rng.random((3000, 1)) < 0.5
    rates = np.where(rng.random((3000, 1)) < 0.9, labels, ~labels) * 0.8 + 0.1  # nothing in the text tells, the source mostly does
    features = np.column_stack([rng.random((3000, 2)) * 0.1, np.full(3000, 2.0), np.zeros(3000), np.zeros(3000)])
    chain = Chain.fit(features, rates, labels)
    assert (chain.decode(features, rates) == labels).mean() > 0.85 and chain.quality[0]["ece"] < 0.05


def test_co_occurrence_decides_where_the_text_does_not(spark):
    """A sixth of the sentences is of farms and one has a word nobody knows: with the sea, which always comes with farms, that is one more; with code it isn't."""
    rng = np.random.default_rng(12)
    examples, areas, _, _ = tables(spark, rng)

    def document(parts):
        body = [line for s, n in parts for line in (about(rng, s, NOUNS[s]) if s else str(rng.choice(FILLER)) for _ in range(n))]
        rng.shuffle(body)
        return "\n".join(body)

    def nobody(i):
        return "".join(chr(97 + int(c)) for c in str(7919 * i + 10**8))

    def farm(i, n):
        return [SHAPES[(i + j) % 4].format(w, nobody(10 * i + j)) for j, w in enumerate(rng.choice(NOUNS["farm"][:5], n))]

    def unknown(i):
        return SHAPES[i % 4].format(nobody(10 * i + 8), nobody(10 * i + 9))

    rows, weak, passing = [], [], []
    for i in range(900):
        if i % 45 == 0:  # three sentences in eighteen tell of farms
            weak.append(i)
            rows.append((i, document([("sea", 5), (None, 9)]) + "\n" + "\n".join([unknown(i), *farm(i, 3)])))
        elif i % 3:
            rows.append((i, document([("sea", 5), (None, 9)]) + "\n" + "\n".join(farm(i, 4))))
        else:
            passing.append(i)
            rows.append((i, document([("code", 5), (None, 9)]) + "\n" + "\n".join([unknown(i), *farm(i, 3)])))
    got = {}
    for r in subject_areas(spark.createDataFrame(rows, "doc_id long, text string"), examples, areas).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    assert np.mean(["farm" in got[i] for i in weak]) > 0.8  # a bare threshold finds none of them
    assert np.mean(["farm" not in got[i] for i in passing]) > 0.95 and np.mean([got[i] == {"sea", "farm"} for i in range(900) if i % 3 and i % 45]) > 0.95


def test_report_and_sources(spark):
    rng = np.random.default_rng(13)
    examples, areas, documents, truth = tables(spark, rng)
    rows = [(i, t, None if i % 5 == 0 else "a" if i % 2 else "b") for i, t in documents] + [(1000, documents[0][1], "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {i: set() for i, _, _ in rows}
    for r in subject_areas(df, examples, areas, source="source").collect():
        got[r["doc_id"]].add(r["subject"])
    assert sum(got[i] == s for i, s in truth.items()) >= 0.95 * len(truth) and got[1000] == got[0]
    report = {r["subject"]: r for r in subject_report(df, examples, areas, source="source").collect()}
    assert set(report) == set(NOUNS) and all(report[s]["n_documents"] == sum(s in x for x in got.values()) for s in NOUNS)
    assert all(r["recall"] > 0.9 and r["precision"] > 0.9 and r["brier"] < 0.05 for r in report.values())
