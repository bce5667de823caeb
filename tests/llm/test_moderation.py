import random

import numpy as np

from lexloom.llm.moderation import choose_threshold, clean, fit, passages, score_documents

BAD = ["you are a filthy idiot", "shut up you stupid cretin", "what a useless idiot", "those stupid rats must be driven out"]
GOOD = ["the tenant shall pay the rent", "the court dismissed the claim with costs", "the filthy filter was replaced", "the notice period runs for two months", "each party bears its own costs", "the seller delivers the goods"]


def corpus(n, seed):
    r = random.Random(seed)
    docs, y = [], []
    for _ in range(n):
        s = [f"{r.choice(GOOD)} {r.choice('abcdefgh') * 5} {r.choice('klmnop') * 4}." for _ in range(r.randint(3, 9))]
        bad = r.random() < 0.3
        if bad:
            s.insert(r.randrange(len(s)), r.choice(BAD).capitalize() + ".")
        docs.append(" ".join(s))
        y.append(float(bad) if r.random() > 0.05 else 1.0 - bad)
    return docs, y


def test_tricks_are_undone():
    assert clean("Sc.hwein") == "schwein" and clean("s u b h u m a n") == "subhuman"
    assert passages("You cr371n, stop it!")[0] == ["you", "cretin"]


def test_held_out_accuracy_with_noise():
    docs, y = corpus(300, 1)
    model = fit(docs, y)

    def scored(seed):
        test, _ = corpus(300, seed)
        return np.array([model.score(d)[0] for d in test]), np.array([any(b.capitalize() in d for b in BAD) for d in test])

    held, known = scored(5)
    threshold = choose_threshold(held, known.astype(float), np.histogram(scored(3)[0], 1000, (0, 1))[0])
    scores, truth = scored(2)
    assert ((scores >= threshold) == truth).mean() > 0.95
    assert model.score("YOU STUP1D IDI0T go away.")[0] > model.score("The tenant shall pay.")[0]
    assert model.score(None) == (0.0, None) and model.score("") == (0.0, None)


def test_threshold():
    counts = np.zeros(10, int)
    counts[[0, 1, 2, 8, 9]] = [800, 90, 10, 5, 45]
    # of all documents 50 score like the labelled positives, 10 lie between
    t = choose_threshold(np.array([0.95, 0.95, 0.82, 0.3, 0.1]), np.array([1.0, 1, 1, 0, 0]), counts)
    assert 0.3 <= t <= 0.8
    # no document at all scores like the labelled positives
    assert choose_threshold(np.array([0.95, 0.05]), np.array([1.0, 0.0]), np.array([90, 0, 0, 0, 0, 0, 0, 0, 0, 0])) >= 0.9
    assert choose_threshold(np.array([0.95, 0.05]), np.array([1.0, 0.0]), np.zeros(10, int)) >= 0.9
    # without anything between the labels' sides the threshold excludes the low ones all the same
    assert choose_threshold(np.array([0.95, 0.05]), np.array([1.0, 0.0]), np.array([90, 0, 0, 0, 0, 0, 0, 0, 0, 10])) == 0.9


def test_frame(spark):
    docs, y = corpus(120, 4)
    rows = [(i, d, "s", 1.0) for i, d in enumerate(docs)] + [(900, None, None, 0.0), (901, "", None, 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(i, int(v), "r") for i, v in enumerate(y[:80])] + [(3, None, "r"), (None, 1, "r"), (5000, 1, "r")], "doc_id long, abusive int, rater string")
    out = {r.doc_id: r for r in score_documents(df, labels).collect()}
    assert len(out) == 122 and out[900].score == 0.0 and not out[901].is_abusive
    assert all(not r.is_abusive for r in score_documents(df, labels.filter("abusive = 0")).collect())
    assert score_documents(df.limit(0), labels).collect() == []


def test_single_words_are_scored():
    long = " ".join(["word"] * 20)
    assert ["idiot"] in passages("The rent is due. Idiot! Pay it.") and ["idiot"] in passages(f'{long}, "idiot", {long}')
    docs, y = corpus(300, 1)
    model = fit(docs, y)
    alone = "The tenant shall pay the rent."
    assert model.score(f"{alone} Idiot!")[0] > model.score(alone)[0] and model.score(f"{alone} Idiot!")[1] == "idiot"


def test_clashing_columns_and_given_model(spark, tmp_path):
    """Columns named like the operator's own, null and repeated ids, and a model fitted before."""
    from lexloom.llm.moderation import fit_labelled, load_fitted, save_fitted

    docs, y = corpus(120, 4)
    names = "score passage is_abusive fold part body doc y rows bias labels step".split()
    rows = [(i, d, *["x"] * len(names)) for i, d in enumerate(docs)] + [(None, docs[0], *[None] * len(names)), (1, docs[1], *["z"] * len(names))]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    labels = spark.createDataFrame([(i, int(v), "r") for i, v in enumerate(y[:80])], "doc_id long, abusive int, text string")
    fitted = fit_labelled(df, labels)
    save_fitted(spark, fitted, str(tmp_path / "model"))
    again = load_fitted(spark, str(tmp_path / "model"))
    a, b, c = (sorted(map(tuple, score_documents(df, labels, fitted=f).collect()), key=str) for f in (fitted, None, again))
    assert a == b == c and len(a) == 122
    assert score_documents(df.limit(0), labels, fitted=fitted).collect() == []


def test_copies_under_other_ids_change_nothing(spark):
    """A table repeated with shifted keys gives the same model, held-out scores and documents: copies don't use up the bound on labelled
    rows, nor does a text stand on both sides of a fold."""
    from pyspark.sql import functions as F

    from lexloom.llm.moderation import fit_labelled

    docs, y = corpus(120, 4)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, abusive int")
    many = lambda x: x.crossJoin(spark.range(10).withColumnRenamed("id", "k")).withColumn("doc_id", F.col("doc_id") + 1000 * F.col("k")).drop("k")
    one, ten = fit_labelled(df, labels, max_labelled=80), fit_labelled(many(df), many(labels), max_labelled=80)
    assert len(ten.scores) == len(one.scores) == 80 and sorted(ten.scores) == sorted(one.scores)
    assert np.array_equal(one.model.rows, ten.model.rows)
    found = lambda d, f: {r.doc_id for r in score_documents(d, labels, fitted=f).filter("is_abusive").collect()}
    assert found(many(df), ten) == {i + 1000 * k for i in found(df, one) for k in range(10)}


def test_a_text_has_the_labels_of_all_its_documents(spark):
    """Two of three readers find a text abusive that stands in three documents; one that readers are at odds about is left out."""
    from lexloom.llm.moderation import fit_labelled

    docs, y = corpus(60, 4)
    rows = [*enumerate(docs), (100, BAD[0]), (101, BAD[0]), (102, BAD[0]), (103, GOOD[0]), (104, GOOD[0]), (102, BAD[0])]
    said = [(i, int(v)) for i, v in enumerate(y)] + [(100, 1), (101, 0), (102, 1), (103, 1), (104, 0)]
    fitted = fit_labelled(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(said, "doc_id long, abusive int"))
    assert len(fitted.labels) == 61 and fitted.labels.sum() == sum(y) + 1
