from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossalith.llm import toxicity
from glossalith.llm.common import bucket_of
from glossalith.llm.language_id import LanguageModel, codewords, identify
from glossalith.llm.language_id import train as train_languages
from glossalith.llm.queries import op1_toxicity, op2_language_id


@pytest.fixture(scope="module")
def model():
    words = Counter({w: 50 for w in "the idiot moron was a clown and stupid people read this book about trash is in of to that it you are".split()})
    n = toxicity.trigram_counts(words).reshape(28, 28, 28)
    one = n.sum((0, 1)) + 1
    two = n.sum(0) + 2 * (one / one.sum())
    two /= two.sum(1, keepdims=True)
    three = n + 5 * two[None]
    return np.log(three / three.sum(2, keepdims=True)).tolist()


@pytest.mark.parametrize("written,meant", [("id1ot", "idiot"), ("m0r0n", "moron"), ("$tupid", "stupid"), ("idiooooot", "idiot"), ("i.d.i.o.t", "idiot"), ("1d10t", "idiot"), ("i d i o t", "idiot"), ("cl*wn", "clown"), ("tr@sh!!", "trash")])
def test_obfuscations_are_restored(model, written, meant):
    assert meant in toxicity.restored_words(written, model)


@pytest.mark.parametrize("plain", ["book", "THE!!".lower(), "people,", "été"])
def test_plain_words_stay(model, plain):
    assert toxicity.restored_words(plain, model) == (plain.strip("!,"),)


def test_tokens_without_letters_or_too_long_say_nothing(model):
    assert toxicity.restored_words("12345", model) == toxicity.restored_words("a1" * 60, model) == toxicity.restored_words("!!", model) == ()


@pytest.mark.parametrize(
    "written",
    ["idi" + "o" * 40 + "t", "i" + "." * 50 + "d.i.o.t", ".".join("idiot") + "." + "_".join(["the", "people", "read", "this", "book"] * 3), "_".join(["the", "people", "id1ot", "read"] * 5), "the*people*are*an*idiot*read*this*book*about", "clown1234people5678idiot1234stupid5678moron", "a" * 20 + "-" + "people-" * 300 + "idi" + "o" * 99 + "t"],
)
def test_long_tokens_are_read_in_pieces(model, written):
    assert "idiot" in toxicity.restored_words(written, model)
    assert all(len(p) <= toxicity.LONGEST for p in toxicity.pieces(written))


def test_marks_in_place_of_blanks_leave_the_evidence(model):
    scorer = toxicity.Scorer(model, {"=idiot": (50, 0), "=moron": (40, 0)}, slope=2.0)
    text = "the people read this book about an idiot and a moron in this book"
    weigh = lambda t: scorer.evidence(scorer.tokens(t), toxicity.WordCache(scorer.token_weight))
    assert weigh(text.replace(" ", "_")) == scorer.weight("=idiot") > 0  # one token: its strongest word counts


def test_lattice_best_path_beats_every_other(model):
    """Viterbi against all readings of a short lattice."""
    import itertools

    steps = toxicity.lattice("1d!0t")
    best = max(
        (sum(-c for _, c in path) + score(model, "".join(x for x, _ in path)), "".join(x for x, _ in path)) for path in itertools.product(*steps)
    )
    assert toxicity.restore("1d!0t", model) == best[1]


def score(model, word):
    x = y = 0
    total = 0.0
    for c in [*word, " "]:
        k = toxicity._symbol(c)
        total += model[x][y][k]
        x, y = y, k
    return total


def test_spaced_letters_are_found():
    assert toxicity.spaced("you are an i d i o t".split()) == ["i d i o t"]
    assert toxicity.spaced("a b c".split()) == []


def test_toxicity_learns_and_ranks_held_out(spark):
    """Planted words in 600 texts: the held-out fifth is told apart, also when the words are obfuscated."""
    rng = np.random.Generator(np.random.PCG64(5))
    vocabulary = ["".join(rng.choice(list("aeiourstnlm"), rng.integers(3, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(600):
        w = list(rng.choice(vocabulary, 60))
        if i % 4 == 0:
            w[10] = "idiot" if i % 8 else "id1ot"
            w[30] = "zorgle" + "".join(rng.choice(list("aeiou"), 3))
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    docs, known = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    scorer = toxicity.train(docs, known, lambda i: bucket_of(i, 5) != 0)
    got = toxicity.score_documents(docs, scorer, extra={"held_out": bucket_of(F.col("doc_id"), 5) == 0}).filter("held_out").collect()
    assert all((r.score >= 0.5) == (r.doc_id % 4 == 0) for r in got) and len(got) > 80


def test_toxicity_query_contract(spark, sf_dir):
    got = op1_toxicity(spark, sf_dir).toPandas()
    assert list(got.columns)[:4] == ["doc_id", "held_out", "score", "predicted"] and got.score.between(0, 1).all()
    assert ((got.score >= 0.5).astype(int) == got.predicted).all() and len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_toxicity_edge_cases(documents, spark):
    docs = documents([(1, None), (2, ""), (3, "x " * 50_000), (3, "x"), (None, "y")])
    empty = spark.createDataFrame([], "doc_id bigint, toxic int")
    scorer = toxicity.train(docs, empty)
    assert sorted(r.score for r in toxicity.score_documents(docs, scorer).collect())[-1] < 0.5
    clashing = spark.createDataFrame([(1, 1, "x"), (1, 0, "y"), (2, None, "z"), (3, 0, "z")], "doc_id bigint, toxic int, text string")
    assert toxicity.score_documents(docs, toxicity.train(docs, clashing)).count() == 5
    assert toxicity.score_documents(docs.limit(0), scorer).count() == 0
    assert {r.restored for r in toxicity.restore_documents(docs, scorer.model).filter("doc_id in (1, 2)").collect()} == {""}


def test_codewords_are_far_apart():
    for n in (2, 3, 4, 5, 9, 20):
        code = codewords(n)
        assert len({tuple(r) for r in code}) == n
        assert min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= (1 if n == 2 else 2)


def test_a_wrong_bit_is_corrected():
    code = codewords(5).astype(np.float32)
    model = LanguageModel(list("abcde"), code, np.eye(code.shape[1], dtype=np.float32), np.zeros(code.shape[1], np.float32))
    noisy = code * 3
    noisy[:, 0] *= -1
    best, p, margin = model.predict(noisy)
    assert best.tolist() == [0, 1, 2, 3, 4] and (p <= 1).all() and (margin > 0).all()


def test_language_query_is_right_on_held_out(spark, sf_dir):
    got = op2_language_id(spark, sf_dir).toPandas().merge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.95 and got.score.between(0, 1).all()


def test_language_edge_cases(documents):
    rows = [(1, "the and of to in", "en"), (2, "der die das und ist", "de"), (3, None, "en"), (4, "12 !!", "de"), (5, "", None), (5, "und " * 30_000, None), (None, "the", None)]
    docs = documents(rows)
    model = train_languages(docs)
    got = {(r.doc_id, r.lang_pred) for r in identify(docs, model).collect()}
    assert {(3, "und"), (4, "und"), (5, "und"), (1, "en"), (2, "de"), (5, "de")} <= got
    assert identify(docs, None).filter("lang_pred <> 'und'").count() == 0
    assert train_languages(docs.limit(0)) is None and identify(docs.limit(0), model).count() == 0


def test_one_language_alone(documents):
    docs = documents([(1, "the", "en"), (2, "of", "en")])
    assert {r.lang_pred for r in identify(docs, train_languages(docs)).collect()} == {"en"}
