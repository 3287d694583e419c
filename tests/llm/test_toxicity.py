import random

import pytest

from pricewatch.llm import toxicity
from pricewatch.llm.toxicity import END

SF = "/root/testdata/sf0.1"


def distances(word, term):
    """Edit distances with transpositions of every beginning of the word to the whole term."""
    d = [[i + j if 0 in (i, j) else 0 for j in range(len(term) + 1)] for i in range(len(word) + 1)]
    for i in range(1, len(word) + 1):
        for j in range(1, len(term) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (word[i - 1] != term[j - 1]))
            if i > 1 and j > 1 and word[i - 1] == term[j - 2] and word[i - 2] == term[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return [row[-1] for row in d]


def test_automaton_against_edit_distances():
    rng = random.Random(4)
    terms = ["abcde" + END, "abca", "aabbccaab" + END, "cabcab", "bacbacbacb"]
    terms += ["".join(rng.choice("abc") for _ in range(rng.randint(4, 10))) + rng.choice(["", END]) for _ in range(12)]
    terms = list(dict.fromkeys(terms))
    automaton = toxicity.Automaton(terms)
    for _ in range(4000):
        word = list(rng.choice(terms).rstrip(END) + rng.choice(["", "", "ab", "x"]))
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(word))
            word[i : i + 1] = rng.choice([[], [rng.choice("abcx")], [word[i], rng.choice("abcx")]])
            if not word:
                break
        word = "".join(word)
        want = {}
        for number, term in enumerate(terms):
            d = distances(word, term.rstrip(END))
            edits = d[-1] if term.endswith(END) else min(d)
            if edits <= toxicity._edits(len(term.rstrip(END))):
                want[number] = edits
        assert dict(automaton.match(word)) == want, word


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.learn(docs, labels)


def score(model, text):
    return toxicity.score_of(toxicity.Matcher(model.terms).hits(text), model)


def test_misspelt_terms_are_caught_and_quotation_is_not_abuse(model):
    assert "idiot" + END in model.terms
    for text in ("you idiot", "What an IDIOT!", "such an id1ot and a stuipd clown"):
        assert score(model, text) >= 0.3, text
    for text in ('she said "idiot" in the report', "plain text", "", None):
        assert score(model, text) < 0.3, text


def test_held_out_labels(spark, model):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = docs.join(labels.where(toxicity.held_out()), "doc_id")
    got = {r["doc_id"]: r["score"] >= 0.3 for r in toxicity.scores(held, model).collect()}
    truth = {r["doc_id"]: r["toxic"] == 1 for r in held.select("doc_id", "toxic").collect()}
    caught = sum(got[d] for d in truth if truth[d]) / sum(truth.values())
    wrong = sum(got[d] for d in truth if not truth[d]) / sum(not t for t in truth.values())
    assert caught >= 0.8 and wrong <= 0.01


def test_odd_rows_empty_tables_and_no_labels(odd_docs, no_docs, labels, model):
    assert toxicity.scores(odd_docs, model).count() == odd_docs.count()
    assert toxicity.scores(no_docs, model).count() == 0
    untaught = toxicity.learn(odd_docs, labels.limit(0))
    assert {r["score"] for r in toxicity.scores(odd_docs, untaught).collect()} == {0.0}
    assert toxicity.accepted(odd_docs, labels).columns == odd_docs.columns


def test_only_near_copies_are_collapsed(spark):
    rng = random.Random(7)
    apart = [f"the de und w{i}" for i in range(60)]  # one word of four is their own
    long = [f"x{rng.randrange(10**6)}" for _ in range(80)]
    copies = [" ".join(long[:i] + ["changed"] + long[i + 1 :]) for i in (5, 20, 40, 60, 78)]
    same = ["Only four words here", "only  four words HERE", "", None, " \n"]
    rows = [(i, label, t) for label in (True, False) for i, t in enumerate(apart + [" ".join(long)] + copies + same)]
    got = toxicity._distinct_texts(spark.createDataFrame(rows, "_id long, toxic boolean, text string")).collect()
    for label in (True, False):
        texts = [r["text"] for r in got if r["toxic"] == label]
        assert set(apart) <= set(texts)
        assert len(texts) == len(apart) + 3  # one long text, one of four words, one empty


def test_shingles_of_odd_texts():
    assert toxicity.shingles(None).tolist() == toxicity.shingles(" \n").tolist()
    assert len(toxicity.shingles("a b c")) == 1 and len(toxicity.shingles("a b c d e f")) == 2
    assert len(toxicity.shingles("\ud800 x")) == 1


def test_one_labelled_id_on_many_rows_stays_within_the_sample(spark):
    rows = [(1, f"vile{i} vicious{i} words {i}") for i in range(800)] + [(2, f"kind words {i}") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    joined = docs.join(labels, "doc_id").select(docs["doc_id"].alias("_id"), (labels["toxic"] == 1).alias("toxic"), "text")
    got = toxicity._distinct_texts(joined, {True: 100, False: 200}).groupBy("toxic").count().collect()
    found = {r["toxic"]: r["count"] for r in got}
    assert 50 < found[True] < 160 and 120 < found[False] < 290


def test_nodes_left_on_spark_could_never_be_significant():
    tried, n_toxic, n_clean = 5000, 300, 900
    fewest = toxicity.fewest_documents(tried, n_toxic, n_clean)
    assert 3 < fewest < 40
    for t in (fewest - 1, fewest):
        chosen = toxicity.choose_terms({"word": t}, {}, n_toxic, n_clean, 0.0, tried)
        assert chosen == (["word"] if t >= fewest else [])


def test_states_are_forgotten_and_made_again(monkeypatch):
    words = ["terrible", "terrable", "horrible", "horibel", "nothing", "terribly", "x"] * 3
    want = [toxicity.Automaton(["terrible", "horrible"]).match(w) for w in words]
    monkeypatch.setattr(toxicity, "MOST_STATES", 5)
    automaton = toxicity.Automaton(["terrible", "horrible"])
    assert [automaton.match(w) for w in words] == want and len(automaton.sets) < 40
