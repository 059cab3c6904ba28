"""License scans and decontamination against plain code."""

import hashlib
import random
import re

import pytest

from quillspan.llm import decontaminate as D
from quillspan.llm import license as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.na.fill({"doc_id": -1}).collect())


LICENSES = [
    (901, "Released under the MIT License. mit, LICENSE; MIT-license"),
    (902, "See the Apache\nLicense, Version 2.0 and the GNU General Public License"),
    (903, "general public licence; public license; mit licensed"),
    (904, "this work is well licensed under the gnu general public license, version 3"),
    (905, "Permission is hereby granted, free of charge, to any person obtaining a copy of this fine software"),
]


def test_license_base(spark, docs, rows, none):
    both = docs.select("doc_id", "text").union(spark.createDataFrame(LICENSES, "doc_id long, text string"))
    want = []
    for i, t in [*rows, *LICENSES]:
        w = words(t)
        at = [(p, label) for phrase, label in L.PHRASES for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split()]
        places = [p for p, _ in at]
        want.append((-1 if i is None else i, len(w), len(at), min(places, default=-1), max(places, default=-1), ",".join(sorted({x for _, x in at}))))
    got = L.scan(both)
    assert rows_of(got.na.fill(-1, ["first_word", "last_word"]), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(want)
    labels = {r.doc_id: (r.labels, r.score) for r in got.collect()}
    assert labels[904][0] == "gpl" and labels[905][0] == "mit" and 0.8 <= labels[905][1] < 1 and labels[4] == ("", 0.0)
    assert L.scan(none).count() == 0


def notice_matches(text):
    """Labels by trying every start, shift and split of every notice, and the best at each word."""
    w, found = words(text), {}
    for number, label, base, grams, needed in L.templates():
        if base:
            continue
        t = [g.split()[0] for g in grams] + [grams[-1].split()[1]]
        for a in range(-len(t), len(w)):
            for b in range(a - L.GAP, a + L.GAP + 1):
                has = [{i for i in range(len(grams)) if d + i >= 0 and w[d + i : d + i + 2] == t[i : i + 2]} for d in (a, b)]
                if len(has[0]) + len(has[1]) < L.SHARE * len(grams) - 1e-9 or not has[0] or not has[1]:
                    continue
                ways = []
                for c in range(len(t)):
                    one, two = [i for i in has[0] if i < c], [i for i in has[1] if i >= c]
                    at = sorted([a + i for i in one]), sorted([b + i for i in two])
                    if len(one) + len(two) >= L.SHARE * len(grams) - 1e-9 and {*needed} <= {*one, *two} and not (at[0] and at[1] and at[0][-1] >= at[1][0]):
                        ways.append((-len(one) - len(two), min(at[0] + at[1]), max(at[0] + at[1]) + 1))
                if ways:
                    n, lo, hi = min(ways)
                    found[label, lo, hi, (-n / len(grams), len(grams))] = 1
    at = {}
    for label, lo, hi, rank in found:
        for p in range(lo, hi + 1):
            at.setdefault(p, []).append((rank, label))
    top = {p: max(r for r, _ in x) for p, x in at.items()}
    return {label for label, lo, hi, rank in found if all(rank == top[p] or (top[p], label) in at[p] for p in range(lo, hi + 1))}


def test_license_notices(spark):
    """Every notice alone, changed and beside others, against brute force; none is taken for another."""
    rng = random.Random(11)
    texts = [("Licensed under CC BY-NC 4.0", {"cc-by-nc"}), ("Licensed under CC BY-NC-SA 4.0", {"cc-by-nc-sa"}), ("licensed under cc by zz 4.0", set()), ("Licensed under CC BY 4.0.", {"cc-by"})]
    texts.append(("under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", {"lgpl"}))
    texts += [(text, {label}) for text, label in L.NOTICES]
    cut = [text.split() for text, _ in L.NOTICES]
    changed = []
    for w in cut * 3:
        w, p = list(w), rng.randrange(len(w))
        w[p : p + rng.randrange(3)] = rng.choices(["zz", "nc", "sa", "gnu", "lesser", "the"], k=rng.randrange(3))
        changed.append(" ".join(rng.choice(cut)[-4:] + w + rng.choice(cut)[:5]))
    every = [t for t, _ in texts] + changed + [" ".join(rng.choice(["the", "license", "under", "cc", "by", "4", "0", "nc"]) for _ in range(400))]
    got = {r.doc_id: r for r in L.scan(spark.createDataFrame(list(enumerate(every)), "doc_id long, text string")).collect()}
    own = lambda r: set(r.labels.split(",")) - {""}
    for i, text in enumerate(every):
        assert own(got[i]) == notice_matches(text) | (set(got[i].base_labels.split(",")) - {""}), text
    for i, (text, want) in enumerate(texts):
        assert own(got[i]) - set(got[i].base_labels.split(",")) <= want <= own(got[i]), text


def brute(rows, items, size=13):
    wins = {}
    for k, t in items:
        w = words(t)
        for s in range(max(1, len(w) - size + 1)) if w else ():
            wins.setdefault(tuple(w[s : s + size]), set()).add(k)
    out = []
    for i, t in rows:
        w, hit, ids = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for s in range(len(w) - n + 1):
                if (found := wins.get(tuple(w[s : s + n]))) is not None:
                    hit.update(range(s, s + n))
                    ids |= found
        ids = sorted(str(x) for x in ids if x is not None)
        digest = hashlib.sha256(",".join(ids).encode()).hexdigest()
        out.append((-1 if i is None else i, len(w), len(hit), len(ids), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out)


COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@pytest.fixture(scope="module")
def items(rows):
    w = words(dict((i, t) for i, t in rows if i == 60)[60])
    long = words(dict((i, t) for i, t in rows if i == 20)[20])
    return [
        (1, " ".join(w[45:80])), (2, " ".join(w[50:65])), (2, " ".join(w[50:65])), (2, "same text here"), (3, None), (4, ""), (5, "nowhere to be found " * 6), (None, " ".join(long[500:520])),
        (6, " ".join(long[100:118] + ["other"] * 3)), (7, "á é"), (8, " ".join(long[-13:])), (9, " ".join(long[:13])),
    ]


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_decontamination(spark, docs, rows, items, none, monkeypatch, most):
    """With ``most`` 0 no table is small enough to be broadcast."""
    monkeypatch.setattr(D.sized, "__defaults__", (most,))
    bench = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, doc_id int")
    assert rows_of(D.contamination(docs, bench), *COLUMNS) == brute(rows, items)
    if most:
        assert D.contamination(none, bench).count() == 0
        assert not any(r.contaminated for r in D.contamination(docs, bench.limit(0)).collect())
        more = [(None, dict(rows)[60]), (None, dict(rows)[60]), (60, "a clean text"), (None, "another clean one")]
        clean = [(-1 if i is None else i, t) for i, t in [*rows, *more] if not brute([(i, t)], items)[0][-1]]
        every = docs.union(spark.createDataFrame([(i, t, "k", 0, 1.5, "w") for i, t in more], docs.schema))
        assert rows_of(D.keep_clean(every, bench).na.fill({"text": "-"}), "doc_id", "text") == sorted((i, "-" if t is None else t) for i, t in clean)
        assert len(clean) < len(rows) + len(more) and D.keep_clean(none, bench).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x alpha gamma y beta delta z"), (2, "alpha " + "pad " * 40 + "beta gamma delta"), (3, None)], "doc_id long, text string")
    tokens = D.item_tokens(spark.createDataFrame([(7, "alpha beta gamma delta")], "item_id long, text string"))
    index = D.build_index(docs)
    found = D.proximity_matches(index, tokens, slop=3, share=1.0)
    ids = index.where("term IS NULL").select("row_id", "doc_id")
    assert {(r.doc_id, r.item_id) for r in found.join(ids, "row_id").collect()} == {(1, 7)}


def test_proximity_without_the_rarest_term(spark):
    item = "one two three four five six seven eight nine ten"
    texts = [(1, item.replace("ten", "x")), (2, "y " + item.replace("one", "a").replace("five", "b")), (3, item.replace("one", "a").replace("two", "b").replace("six", "c")), (4, "ten"), (5, None), (None, item)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = D.scan(docs, spark.createDataFrame([(7, item), (8, "alpha beta gamma delta epsilon"), (9, None)], "item_id long, text string")).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert sorted((r.doc_id or 0, r.n_near_items, r.near_items_sha256 == sha("7")) for r in got) == [(0, 1, True), (1, 1, True), (2, 1, True), (3, 0, False), (4, 0, False), (5, 0, False)]


def test_postings_of_item_words_are_read_once(spark):
    """The fast split gives the words of the contract, and later steps get the items' words only, numbered in order."""
    from pyspark.sql import functions as F

    from quillspan.llm import decontaminate as D
    from quillspan.llm.text import lower_word, split_words, words_column

    odd = ["".join(map(chr, range(128))), "ÉTÉ İxKY ..A\x7fb C--", "", "...", "-Ab-", None, "世界1 Z\U0001f600z"]
    texts = spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "doc_id long, text string")
    met = texts.select(F.transform(split_words(F.col("text")), lower_word).alias("a"), words_column(F.col("text")).alias("b")).collect()
    assert all(r.a == r.b for r in met) and sum(len(r.b) for r in met) == 10
    docs = spark.createDataFrame([(1, "x B a"), (2, "c a"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([("i", "b A z")], "item_id string, text string")
    own, tokens = D.own_postings(D.build_index(docs), D.item_tokens(items))
    number = {r.ipos: r.term for r in tokens.collect()}
    assert number[1] < number[0] < number[2]
    assert sorted((r.pos, r.term) for r in own.collect()) == [(1, number[1]), (1, number[0]), (2, number[1])]
