"""Toxicity: the automaton against edit distances, and held-out accuracy."""

import random
import zlib

import pytest

from quillspan.llm import toxicity as X


def prefix_distance(term, word):
    """Least edits between the term and some beginning of the word."""
    row = list(range(len(word) + 1))
    for i, c in enumerate(term, 1):
        last, row = row, [i]
        for j, x in enumerate(word, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != x)))
    return min(row)


def test_automaton_meets_trie():
    rng = random.Random(6)
    terms = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(5, 8))) for _ in range(12)})
    trie, halves = X.build_trie(terms), X.Halves(terms)
    for _ in range(800):
        word = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 10)))
        near = [prefix_distance(t, word) for t in terms]
        found = X.intersect(word, trie)
        assert (found[1] if found else None) == (min(near) if min(near) <= 1 else None)
        if found:
            assert near[found[0]] == found[1] and halves.may_hold(word)


def test_quotation():
    assert X.between_quotes('he said "you ', ' fool" today') and X.between_quotes("« tu es ", " »")
    assert not X.between_quotes('"done" and ', ' then "x"') and not X.between_quotes("you ", " there")


@pytest.fixture(scope="module")
def labelled(spark, words):
    rng = random.Random(8)
    rows, labels = [], []
    bad = ["grobnik", "zluffer", "mandrake", "vexlop"]
    for i in range(900):
        w = [rng.choice(words) for _ in range(60)]
        toxic = rng.random() < 0.25
        if toxic:
            for b in rng.choices(bad, k=3):
                w.insert(rng.randrange(60), b + rng.choice(["", "", "s", "ung"]))
        rows.append((i, " ".join(w), "x", 1))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, source string, toxic int"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_held_out_accuracy(spark, labelled, docs, none):
    rows, labels, known = labelled
    got = X.toxicity(rows, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    wrong = [r.doc_id for r in got if r.predicted != known[r.doc_id]]
    assert len(wrong) <= 4
    model = X.fit(rows, labels)
    scorer = X.Scorer(model)
    assert scorer.score(b"you zlufer and mandrakes there") >= 0.3 > scorer.score(b"")
    assert X.score(none, model).count() == 0
    assert {r.score for r in X.score(docs, model).where("doc_id <= 3").collect()} == {scorer.score(b"")}
    # Labels of held-out ids change nothing.
    from pyspark.sql import functions as F

    other = labels.withColumn("toxic", F.when(X.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert X.fit(rows, other) == model
    kept = {r.doc_id for r in X.keep_clean(rows, labels).collect()}
    assert kept == {r.doc_id for r in got if not r.predicted}


def test_scores_by_brute_force(spark, labelled):
    """Every score from all terms against all words, without trie, automaton or memory."""
    import math
    import re

    rows, labels, _ = labelled
    model = X.fit(rows, labels)
    near = [i for i, (t, w) in enumerate(zip(model.terms, model.weights)) if len(t) >= X.MIN_FUZZY and w[1] > 0]
    texts = [r.text for r in rows.limit(60).collect()] + ["", None, 'he said "you grobnk" and left', "a" * 5000 + " grobnik " + "zlufferx" * 9, "GROBNIK vexlp mandraKe" * 3]

    def match(word):
        exact = [(-len(t), i) for i, t in enumerate(model.terms) if word.startswith(t)]
        if exact:
            return min(exact)[1], 0
        close = min(((prefix_distance(model.terms[i], word[:80]), -len(model.terms[i]), k) for k, i in enumerate(near)), default=(9,))
        return (near[close[2]], 1) if close[0] == 1 else None

    def score(text):
        data = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        spans = [(m.group(), *m.span()) for m in re.finditer("[0-9a-z\x80-\U0010ffff]+", data)]
        values = []
        for i, (word, begin, end) in enumerate(spans):
            if found := match(word):
                around = spans[max(0, i - 6) : i + 7]
                quoted = X.between_quotes(data[around[0][1] : begin], data[end : around[-1][2] + 4]) or any(w in X.REPORTING for w, _, _ in around)
                value = model.weights[found[0]][found[1]] * (model.quoted if quoted else 1.0)
                if value > 0:
                    values.append((value, found[0]))
        f = [max(v for v, _ in values), math.log1p(len({t for _, t in values})), math.log1p(len(values))] if values else [0.0] * 3
        z = model.coefficients[0] + sum(a * b for a, b in zip(model.coefficients[1:], f))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    got = X.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    want = [score(t) for t in texts]
    assert all(abs(r.score - w) < 1e-9 and r.predicted == (w >= 0.3) for r, w in zip(got, want))
    assert len(set(want)) > 5


def test_without_labels(docs, labelled, none):
    _, labels, _ = labelled
    assert {r.predicted for r in X.toxicity(docs, labels.limit(0)).collect()} == {0}
    assert X.toxicity(none, labels).count() == 0
