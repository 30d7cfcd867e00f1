import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import queries as Q, toxicity as X

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("held_out", Q.fold(5) == 0)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = X.character_model(docs)
    return docs, labels, model, X.train(docs, labels, ~F.col("held_out"), model)


def test_trigrams_match_a_plain_count():
    want = np.zeros(27**3, int)
    for word in ["das", "ol", "ab", "a", "b", "c", "d"]:
        codes = [0, 0, *(ord(c) - 96 for c in word), 0]
        for k in range(len(codes) - 2):
            want[codes[k] * 729 + codes[k + 1] * 27 + codes[k + 2]] += 1
    got = X.trigram_counts(["Das Öl, ab!", "", "a", "b-c  d"])
    # trigrams between words, of two boundaries and one more, say nothing
    words = np.arange(27**3) // 27 % 27 + np.arange(27**3) % 27 > 0
    assert (got[words] == want[words]).all()


def test_character_model_counts_every_text(spark, docs):
    texts = [r.text or "" for r in docs.select("text").collect()]
    counts = sum(X.trigram_counts([t]) for t in texts).reshape(27, 27, 27)
    # a part's texts are counted together, with boundaries between them
    letters = counts[:, :, 1:].sum()
    found = X.character_model(docs)
    assert found.shape == (27, 27, 27) and np.allclose(np.exp(found).sum(axis=2), 1)
    assert np.allclose(found[:, :, 1:], X.smoothed(counts.astype(float))[:, :, 1:], atol=0.05) and letters > 0


@pytest.mark.parametrize("token", ["1d1ot", "tr*sh", "cl0wn", "m.o.r", "i d i o t", "looser", "sss$", "a-b"])
def test_viterbi_finds_the_best_reading(trained, token):
    model = trained[2].tolist()
    best = X.decode(token, model)
    paths = [("", 0.0)]
    for readings in X.lattice(token):
        paths = [(t + letters, s + cost) for t, s in paths for letters, cost in readings]

    def total(text, score):
        a = b = 0
        for c in text:
            k = 0 if c == " " else ord(c) - 96
            score += model[a][b][k] if k or b else 0.0
            a, b = (b, k) if k else (0, 0)
        return score + (model[a][b][0] if b else 0.0)

    top = max(total(t, s) for t, s in paths)
    assert any(" ".join(t.split()) == " ".join(best.split()) and total(t, s) > top - 1e-9 for t, s in paths)


def test_both_searches_agree(monkeypatch):
    rng = np.random.default_rng(1)
    model = X.smoothed(rng.integers(0, 1000, (27, 27, 27)).astype(float))
    letters = list("aabbcde 01!*|-.é你ßß#%")
    for block in (5, X.BLOCK):
        monkeypatch.setattr(X, "BLOCK", block)
        for _ in range(100):
            steps = X.lattice(X.folded("".join(rng.choice(letters, rng.integers(1, 24)))))
            assert X._search_few(steps, model.tolist()) == X._search_arrays(steps, model)


def test_long_runs_take_seconds():
    import time

    learned = X.WordModel({"idiot": 3.0, "asshole": 4.0}, -4.0, 2.0)
    model = X.smoothed(np.zeros((27, 27, 27))).tolist()
    reader = X.TextReader(X.Restorer(model, learned.disguised()), learned)
    start = time.perf_counter()
    for text in ("* " * 200_000, "# " * 200_000, "1 + " * 100_000, "- * " * 100_000, "4 5 5 " * 60_000):
        assert reader.evidence(text) == 0
    # letters among the marks: nothing is cut, and the word behind the run counts
    assert reader.evidence("x * " * 20_000 + "idiot") == 3
    # a run without a letter is one wanted word or nothing
    assert [reader.evidence(t) for t in ("1 d 1 0 t", "4 $ $ # 0 1 3", "4 5 5", "* * * * *")] == [3, 4, 0, 0]
    assert time.perf_counter() - start < 60


def test_disguised_words_are_restored(trained):
    restorer = X.Restorer(trained[2].tolist(), trained[3].disguised())
    cases = {
        "you 1d10t": "you idiot", "i d i o t": "idiot", "cl0wn!!": "clown", "m.o.r.o.n": "moron", "$cum": "scum",
        "tra$h": "trash", "stuuuupid": "stupid", "stuupid": "stupid", "w0rthle$$": "worthless", "IDIOT": "idiot",
        "m*ron": "moron", "plain words stay": "plain words stay",
    }
    assert {t: X.restore(t, restorer) for t in cases} == cases


def test_letters_outside_a_to_z_stay(trained):
    restorer = X.Restorer(trained[2].tolist(), trained[3].disguised())
    cases = {
        "imbe\u0301cile": "imbecile", "IMBE\u0301CILE": "imbecile", "i\u0336d\u0336i\u0336o\u0336t\u0336": "idiot", "İdiot": "idiot",
        "große": "große", "Größße": "größße".replace("ö", "o"), "durak-дурак": "durakдурак", "д.у.р.а.к": "дурак", "дурррак": "дурак",
        "и\u0306": "й", "ДУРАК!": "дурак", "हिन्दी": "हिन्दी", "ภาษาไทย": "ภาษาไทย", "l\u0301": "l",
    }
    assert {t: " ".join(restorer.words(t)) for t in cases} == cases
    # no letter is lost beside hyphens, digits or runs
    for token in ("Straßen-Fest", "groß3", "œuvre-œuvre", "какой-то", "в3к", "łłłódź", "你好,世界", "ααα-β"):
        kept = {c for c in X.core_of(token) if X.is_other(c)}
        assert kept and kept <= set("".join(restorer.words(token)))


def test_tokens_without_a_letter():
    model = X.smoothed(np.zeros((27, 27, 27))).tolist()
    restorer = X.Restorer(model, {X.collapsed(w) for w in ("salt", "asshole", "ass")})
    got = {t: restorer.words(t) for t in ("$417", "4$$#013", "455", "1,000", "2024", "$5.00", "+-+", "!!!")}
    assert got == {"$417": ["salt"], "4$$#013": ["asshole"], "455": [], "1,000": [], "2024": [], "$5.00": [], "+-+": [], "!!!": []}


def test_decomposed_texts_count_as_composed():
    assert (X.trigram_counts(["Das O\u0308l, e\u0301te\u0301"]) == X.trigram_counts(["Das Öl, été"])).all()


def test_evidence_in_other_scripts():
    learned = X.WordModel({"дурак": 3.0, "große": 2.0, "imbecile": 5.0}, -4.0, 2.0)
    reader = X.TextReader(X.Restorer(X.smoothed(np.zeros((27, 27, 27))).tolist(), learned.disguised()), learned)
    assert [reader.evidence(t) for t in ("дурррак", "gro\u00dfe", "imbe\u0301cile", "д-у-р-а-к")] == [3, 2, 5, 3]


def test_held_out_and_disguised(spark, trained):
    docs, labels, model, learned = trained
    scored = X.score(docs, model, learned, ["doc_id", "held_out"]).join(labels, "doc_id").toPandas()
    assert learned.weights and scored.score.between(0, 1).all()
    held = scored[scored.held_out]
    assert (held.predicted == held.toxic).mean() > 0.9
    assert scored.predicted[scored.toxic == 0].mean() < 0.02
    clean = "the and attion to thanedble the anea eriner"
    rows = [(1, clean), (2, clean + " you 1d10t and m0r0n"), (3, clean + " w o r t h l e s s c l 0 w n"), (4, ""), (5, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.score, r.predicted) for r in X.score(frame, model, learned, ["doc_id"]).collect()}
    assert got[2][1] == 1 and got[3][1] == 1 and got[1][1] == 0 and got[1] == got[4] == got[5]


def test_edges(edges, edge_rows, nothing, spark):
    labels = spark.createDataFrame([(1, 0, 1), (None, 1, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
    model = X.character_model(edges)
    learned = X.train(edges, labels, F.lit(True), model)
    rows = X.score(edges, model, learned, ["doc_id"]).collect()
    assert len(rows) == len(edge_rows) and all(0 <= r.score <= 1 for r in rows)
    none = X.train(nothing, labels, F.lit(True), X.character_model(nothing))
    assert none.weights == {} and none.probability(np.zeros(1))[0] == pytest.approx(0.5)
    assert X.score(nothing, model, none, ["doc_id"]).collect() == []


def test_words_are_chosen_by_significance(spark):
    """Against the plain formula, with zeros among the counts."""
    import math

    rows = [("bad", 18, 0), ("half", 10, 10), ("rare", 2, 0), ("clean", 0, 50), ("worse", 30, 2), ("once", 1, 0)]
    toxic, clean = 40, 300

    def ratio(a, b):
        n, held = toxic + clean, a + b
        cells = [(a, held * toxic / n), (b, held * clean / n), (toxic - a, (n - held) * toxic / n), (clean - b, (n - held) * clean / n)]
        return 2 * sum(k * math.log(k / e) for k, e in cells if k)

    least = 2 * math.log(5 / 0.05)
    got = X.choose_words(spark.createDataFrame(rows, "word string, a long, b long"), toxic, clean)
    want = {w for w, a, b in rows if a >= 2 and a * clean > b * toxic and ratio(a, b) > least}
    assert set(got) == want == {"bad", "half", "worse"}
    assert got["bad"] == pytest.approx(math.log(18.5 / 41) - math.log(0.5 / 301))


def test_features_and_evidence(spark):
    row = spark.createDataFrame([(["abc", "abcde", "abcdef", "abcde"],)], "w array<string>").select(X.features(F.col("w")).alias("f")).first()
    assert sorted(row.f) == ["abc", "abcd*", "abcde", "abcde*", "abcdef"]
    learned = X.WordModel({"bad": 3.0, "dread*": 2.0, "dreadful": 5.0}, -4.0, 2.0)
    assert [learned.of(w) for w in ("bad", "badly", "dread", "dreadly", "dreadful")] == [3.0, 0.0, 0.0, 2.0, 5.0]
    model = X.smoothed(np.zeros((27, 27, 27))).tolist()
    reader = X.TextReader(X.Restorer(model, learned.disguised()), learned)
    assert reader.evidence("Bad, bad! dreadly dreadest fine dreadful.") == 3 + 2 + 2 + 5
    assert reader.evidence("") == reader.evidence("fine fine") == 0
    assert np.allclose(learned.probability(np.array([0.0, 4.0])), [1 / (1 + np.exp(4)), 0.5])
