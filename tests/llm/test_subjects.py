import random

from loomstack.llm import subjects as S

TERMS = {"law": ["docket", "verdict", "witness statement", "notary deed", "appeal brief"], "music": ["piano roll", "choir", "drum loop", "concert hall", "chord"], "sport": ["goalkeeper", "league table", "referee", "stadium", "relay split"]}
FRAMES = ["the {} view shows the wrong {}.", "search for {} returns everything but {}.", "a missing {} is no error, a missing {} is."]
FILLER = ["rebased on main, no conflicts.", "the test was flaky, so we ran it again.", "formatting only, no behaviour change.", "let me look at the log first."]


def corpus(n, seed):
    rng = random.Random(seed)
    docs, truth = [], {}
    for i in range(n):
        about = set() if i % 10 == 0 else set(rng.sample(sorted(TERMS), 2 if i % 7 == 0 else 1))
        parts = [rng.choice(FILLER) for _ in range(rng.randint(2, 5))]
        for s in about:
            parts += [rng.choice(FRAMES).format(rng.choice(TERMS[s]), rng.choice(TERMS[s])) for _ in range(rng.randint(3, 6))]
        rng.shuffle(parts)
        docs.append((i, " ".join(parts), rng.choice(["en", "en", None])))
        truth[i] = about
    return docs, truth


def test_held_out_accuracy(spark):
    docs, truth = corpus(600, 1)
    labelled = [(i, s) for i in truth if i % 4 == 1 for s in truth[i]] + [(10_000, "law"), (5, "unknown subject"), (None, "law")]
    d = spark.createDataFrame(docs + [(7000, None, "en"), (7001, "", None), (7002, " \n", "de"), (7003, "a " * 40_000, "en")], "doc_id long, text string, lang string").selectExpr("*", "1 as subjects", "2 as feats")
    got = S.classify(d, spark.createDataFrame(labelled, "doc_id long, subject string"), sorted(TERMS)).collect()
    found = {(r.doc_id, r.subject) for r in got}
    want = {(i, s) for i in truth if not any(x[0] == i and x[1] in TERMS for x in labelled) for s in truth[i]}
    assert len(found & want) / len(found) > 0.95 and len(found & want) / len(want) > 0.95
    assert all(0.5 <= r.posterior <= 1 for r in got) and not {7000, 7001, 7002} & {r.doc_id for r in got}


def test_no_labels_no_documents(spark):
    d = spark.createDataFrame([(1, "x", "en")], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, subject string")
    assert S.classify(d, none, ["law"]).count() == 0
    assert S.classify(d.where("false"), spark.createDataFrame([(1, "law")], "doc_id long, subject string"), ["law"]).count() == 0


def test_segments():
    assert S.segments(None) == [] and S.segments(" . \n ") == []
    assert len(S.segments("One two. three four\nfive")) == 3 and S.segments("触媒です。次です。") != []
