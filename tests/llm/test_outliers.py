import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import outliers as O


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    seen, same = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            same += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered.update(range(i, i + 5))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), same, len(covered)


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(frame):
    found = frame.select("text", *[c.alias(k) for k, c in O.base_statistics(F.col("text")).items()]).collect()
    for r in found:
        assert tuple(r[k] for k in STATS) == brute(r.text), r.text


def test_statistics_of_edges(edges):
    statistics(edges)


def test_statistics_of_documents(docs):
    statistics(docs)


def test_statistics_of_repetitions(spark):
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(list("ab"), n)) for n in range(0, 60)]
    texts += ["\n".join(rng.choice(["x y", "z", "", " "], n)) for n in range(1, 20)]
    texts += ["a b c d e a b c d e", "a b c d e f a b c d", "a a a a a a", "é # é\x0b|", "a\xa0b c"]
    statistics(spark.createDataFrame([(t,) for t in texts], "text string"))


def numpy_mcd(x, floors, share=O.HALF):
    """Concentration steps from medians and median deviations, on the whole matrix at once."""
    ridge = np.diag(np.square(floors))
    centre = np.median(x, axis=0)
    cov = np.diag(np.square(1.4826 * np.median(np.abs(x - centre), axis=0))) + ridge
    for _ in range(O.STEPS):
        d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
        own = x[d <= np.sort(d)[int(np.ceil(share * len(d))) - 1]]
        centre, cov = own.mean(axis=0), np.cov(own.T, bias=True) + ridge
    d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
    own = x[d <= O.CUTOFF / 2]
    centre, cov = own.mean(axis=0), np.cov(own.T, bias=True) + ridge
    return np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)


def test_distances_match_a_matrix_computation(spark):
    rng = np.random.default_rng(5)
    x = rng.multivariate_normal([5, 5, 0, 0, 0], np.diag([1, 0.2, 0.01, 0.01, 0.01]) + 0.005, 301)
    x[:30, 2] += 3
    groups = [("en", "a")] * 201 + [("en", "b")] * 100
    rows = [(i, *g, *map(float, v)) for i, (g, v) in enumerate(zip(groups, x))]
    frame = spark.createDataFrame(rows, "row long, lang string, source string, x0 double, x1 double, x2 double, x3 double, x4 double")
    got = {r.row: r.distance for r in O.robust_distances(frame).collect()}
    want = np.concatenate([numpy_mcd(x[:201], O.FLOORS), numpy_mcd(x[201:], O.FLOORS)])
    assert np.allclose([got[i] for i in range(301)], want, rtol=1e-6)
    assert (want[:30] > O.CUTOFF).all() and (want[30:] < O.CUTOFF).all()


def test_two_fifths_of_a_group_may_be_junk(spark):
    """A hot source of 40% junk, beside a clean one; junk is spread, so that fitting it swells the covariance."""
    rng = np.random.default_rng(7)
    x = rng.multivariate_normal([5, 5, 0.1, 0.1, 0], np.diag([0.3, 0.1, 0.001, 0.005, 0.001]), 600)
    junk = np.arange(600) < 160
    x[junk] += rng.uniform(0.5, 3, (160, 1)) * np.array([-1, 2, 0.4, 0.4, 0.3])
    rows = [(i, "en", "hot" if i < 400 else "b", *map(float, v)) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "row long, lang string, source string, x0 double, x1 double, x2 double, x3 double, x4 double")
    got = {r.row: r.distance for r in O.robust_distances(frame).collect()}
    far = np.array([got[i] for i in range(600)]) > O.CUTOFF
    assert far[junk].mean() > 0.9 and not far[~junk].any()


def test_small_groups_are_pooled(spark):
    rows = [(i, "en", f"s{i % 20}", 5.0 + i % 7 / 7, 5.0, 0.0, 0.0, 0.0) for i in range(100)]
    rows += [(1000, "fr", None, 5.0, 5.0, 9.0, 0.0, 0.0)]
    frame = spark.createDataFrame(rows, "row long, lang string, source string, x0 double, x1 double, x2 double, x3 double, x4 double")
    got = {r.row: r.distance for r in O.robust_distances(frame).collect()}
    assert len(got) == 101 and got[1000] is None and max(v for k, v in got.items() if k < 1000) < 20


def test_edges(edges, edge_rows, nothing):
    rows = O.judge(edges).collect()
    assert len(rows) == len(edge_rows)
    for r in rows:
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed)
    assert O.judge(nothing).collect() == []


def test_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = O.judge(docs).join(labels, "doc_id").toPandas()
    fine = rows[(rows.quality == 1) & ~rows.base_failed]
    poor = rows[(rows.quality == 0) & ~rows.base_failed]
    assert fine.kept.mean() > 0.99 and poor.kept.mean() < 0.1


def test_no_python_on_the_main_path(docs):
    plan = O.judge(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
