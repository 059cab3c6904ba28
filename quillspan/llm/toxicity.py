"""Toxicity: a learned lexicon in a trie, misspellings by Levenshtein automata, and context."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quillspan.llm.text import WORD_BYTES, arrow_schema, kept_in_worker, map_texts
from quillspan.session import materialize

#: Labelled documents that the lexicon and the weights are fitted on, at most.
MAX_TRAIN = 20_000
#: Prefix lengths (in code points) that may become terms; every other word of three and more may as a whole.
PREFIXES = range(4, 9)
#: Least likelihood ratio statistic of a term against the labels.
EVIDENCE = 25.0
#: Least ratio of a term's share of toxic documents to that of clean ones.
MIN_RATIO = 10
#: Documents that a weight of its own must rest on.
SUPPORT = 20
#: Shorter terms are matched as they stand only.
MIN_FUZZY = 5
#: Words to either side of a hit that are looked at for signs of quotation.
CONTEXT = 6
#: Distinct words whose match a Python worker remembers.
REMEMBERED = 100_000
THRESHOLD = 0.3

# Words near a term that report it instead of using it.
REPORTING = "quote quoted quotes quoting said says saying word words term phrase called calls wrote zitat sagte wort dit mot citation dijo palabra cita".split()
OPENING, CLOSING = "\"“„«‹", "\"”“»›"


@dataclass
class Node:
    """A trie node: children, and the term that ends here, if one does."""

    children: dict[str, Node] = field(default_factory=dict)
    term: int = -1


def build_trie(terms: list[str]) -> Node:
    top = Node()
    for i, term in enumerate(terms):
        node = top
        for c in term:
            node = node.children.setdefault(c, Node())
        node.term = i
    return top


def intersect(word: str, trie: Node) -> tuple[int, int] | None:
    """(term, edits) of the closest term, of at most one edit, that the word begins with.

    The automaton of the word runs down the trie. Bit i of ``exact`` (``edited``) is the
    state in which i code points of the word are read with no (one) edit; a branch is left
    as soon as no state is on. Of terms as close as each other the longest counts.
    """
    at: dict[str, int] = {}
    for i, c in enumerate(word):
        at[c] = at.get(c, 0) | 1 << i
    full = (2 << len(word)) - 1
    best, todo = None, [(trie, 1, 3, 0)]
    while todo:
        node, exact, edited, depth = todo.pop()
        if node.term >= 0:
            found = (0 if exact else 1, -depth, node.term)
            if best is None or found < best:
                best = found
        for c, child in node.children.items():
            here = at.get(c, 0)
            moved = (exact & here) << 1
            one = (((edited & here) << 1) | exact | exact << 1 | moved << 1) & full
            if moved | one:
                todo.append((child, moved, one, depth + 1))
    return best and (best[2], best[0])


class Halves:
    """Tells words that can't begin within one edit of a term from those that may.

    One edit leaves the first half of a term at its place, or the second half at its
    place or the one before or behind it.
    """

    def __init__(self, terms: list[str]):
        self.parts: dict[tuple[int, int], set[str]] = {}
        for term in terms:
            cut = len(term) // 2
            for begin, part in ((0, term[:cut]), *((cut + shift, term[cut:]) for shift in (-1, 0, 1))):
                self.parts.setdefault((begin, begin + len(part)), set()).add(part)
        self.checks = [(a, b, found) for (a, b), found in self.parts.items()]

    def may_hold(self, word: str) -> bool:
        return any(word[a:b] in found for a, b, found in self.checks)


@dataclass
class Model:
    """A fitted lexicon. ``weights`` has, for each term, those of exact and of misspelled hits."""

    terms: list[str]
    weights: list[tuple[float, float]]
    quoted: float
    coefficients: list[float]


class Scorer:
    """Finds the hits of a text and makes features and a score of them."""

    def __init__(self, model: Model):
        self.model = model
        self.number = {t: i for i, t in enumerate(model.terms)}
        self.sizes = sorted({len(t) for t in model.terms}, reverse=True)
        fuzzy = [t for t, (_, near) in zip(model.terms, model.weights) if len(t) >= MIN_FUZZY and near > 0]
        self.fuzzy = [self.number[t] for t in fuzzy]
        self.trie, self.halves = build_trie(fuzzy), Halves(fuzzy)
        self.seen: dict[bytes, tuple[int, int] | None] = {}

    def match(self, word: str) -> tuple[int, int] | None:
        for n in self.sizes:
            if (i := self.number.get(word[:n])) is not None:
                return i, 0
        if self.halves.may_hold(word) and (found := intersect(word[: self.sizes[0] + 1], self.trie)):
            return self.fuzzy[found[0]], found[1]
        return None

    def matches(self, words: set[bytes]) -> dict[bytes, tuple[int, int]]:
        if len(self.seen) > REMEMBERED:
            self.seen = {}
        for w in [w for w in words if w not in self.seen]:
            self.seen[w] = self.match(w.decode("utf-8", "replace"))
        return {w: m for w in words if (m := self.seen[w])}

    def hits(self, data: bytes) -> list[tuple[int, int, bool]]:
        """(term, edits, quoted) of every word that a term is found in."""
        data = data.lower()
        found = self.matches(set(WORD_BYTES.findall(data)))
        if not found:
            return []
        spans = [(m.group(), m.start(), m.end()) for m in WORD_BYTES.finditer(data)]
        out = []
        for i, (word, begin, end) in enumerate(spans):
            if match := found.get(word):
                near = spans[max(0, i - CONTEXT) : i + CONTEXT + 1]
                before = data[near[0][1] : begin].decode("utf-8", "replace")
                after = data[end : near[-1][2] + 4].decode("utf-8", "replace")
                words = {w.decode("utf-8", "replace") for w, _, _ in near}
                out.append((*match, between_quotes(before, after) or not words.isdisjoint(REPORTING)))
        return out

    def value(self, hit: tuple[int, int, bool]) -> float:
        term, edits, quoted = hit
        return self.model.weights[term][edits] * (self.model.quoted if quoted else 1.0)

    def features(self, data: bytes) -> list[float]:
        values = [(v, h[0]) for h in self.hits(data) if (v := self.value(h)) > 0]
        if not values:
            return [0.0, 0.0, 0.0]
        return [max(v for v, _ in values), math.log1p(len({t for _, t in values})), math.log1p(len(values))]

    def score(self, data: bytes) -> float:
        z = self.model.coefficients[0] + sum(a * b for a, b in zip(self.model.coefficients[1:], self.features(data)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def between_quotes(before: str, after: str) -> bool:
    """Whether a quotation that opens before a word closes after it."""
    opened = max(before.rfind(c) for c in OPENING)
    closed = max(before.rfind(c) for c in CLOSING if c not in OPENING)
    if opened <= closed or opened < 0 or before[opened] == '"' and before.count('"') % 2 == 0:
        return False
    return any(c in after for c in CLOSING)


def held_out(id_col: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))), F.lit(4)) == 2


def training_rows(docs: DataFrame, labels: DataFrame, most: int, *, id_col: str, text_col: str) -> DataFrame:
    """(text, toxic) of at most ``most`` labelled rows that aren't held out, in the order of a hash of their ids."""
    known = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(most)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return materialize(texts.join(F.broadcast(chosen), "id").select("text", "toxic"), "training")


def candidate_terms(train: DataFrame) -> DataFrame:
    """(term, t, c): in how many toxic and clean documents each word and prefix occurs.

    Copies of a passage say no more than one does. A bit map of the words that come before
    a term in toxic documents shows how many places it truly has: while few of its 64 bits
    are set, the term counts no more often than that.
    """
    out = "term string, toxic int, n long, before long"
    arrow = arrow_schema(train, out)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        before: dict[str, int] = {}

        def counted():
            terms, toxic = zip(*counts)
            bits = np.array([before.get(t, 0) if y else 0 for t, y in counts], dtype=np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(terms), pa.array(toxic, pa.int32()), pa.array(list(counts.values()), pa.int64()), pa.array(bits)], schema=arrow
            )

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = WORD_BYTES.findall((text or "").encode().lower())
                pairs = set(zip([b"", *words], words)) if toxic else {(b"", w) for w in words}
                terms = set()
                for last, word in pairs:
                    word = word.decode("utf-8", "replace")
                    own = [word[:n] for n in PREFIXES if n <= len(word)]
                    if len(word) > max(PREFIXES) or len(word) == 3:
                        own.append(word)
                    terms.update(own)
                    if toxic:
                        bit = 1 << (crc32(last) & 63)
                        for t in own:
                            before[t] = before.get(t, 0) | bit
                counts.update((t, toxic) for t in terms)
                if len(counts) > REMEMBERED:
                    yield counted()
                    counts.clear()
                    before.clear()
        if counts:
            yield counted()

    toxic = F.col("toxic") == 1
    sums = train.mapInArrow(count, out).groupBy("term").agg(
        F.sum(F.when(toxic, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(toxic, 0).otherwise(F.col("n"))).alias("c"), F.bit_count(F.bit_or("before")).alias("places")
    )
    return sums.select("term", F.when(F.col("places") < 40, F.least("t", "places")).otherwise(F.col("t")).alias("t"), "c")


def log_odds(t: float, c: float, toxic: int, clean: int) -> float:
    return math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))


def choose_terms(rows: list[tuple[str, int, int]], toxic: int, clean: int) -> list[str]:
    """Terms by likelihood ratio; none that another chosen one begins with, or the other way round."""

    def ratio(t: int, c: int) -> float:
        g, n = 0.0, toxic + clean
        for k, size in ((t, toxic), (c, clean)):
            for x, share in ((k, (t + c) / n), (size - k, 1 - (t + c) / n)):
                if x:
                    g += 2 * x * math.log(x / (size * share))
        return g

    ranked = sorted(((-round(ratio(t, c), 6), -len(term), term) for term, t, c in rows if t * clean > MIN_RATIO * c * toxic))
    chosen: dict[str, None] = {}
    sizes: set[int] = set()
    begins: set[str] = set()
    for g, _, term in ranked:
        if -g < EVIDENCE:
            break
        if term not in begins and not any(n < len(term) and term[:n] in chosen for n in sizes):
            chosen[term] = None
            sizes.add(len(term))
            begins.update(term[:n] for n in range(1, len(term) + 1))
    return list(chosen)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> list[float]:
    """Coefficients, the intercept first, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * np.r_[0, w[1:]]
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.diag([1e-6, *[1] * (len(w) - 1)])
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def fit(docs: DataFrame, labels: DataFrame, *, most: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model of labelled rows that aren't held out; what reaches the driver is bounded by ``most``.

    Every word and prefix of the sample that has the evidence is a term; there is no other bound.
    Each weight is the log odds of a hit in toxic against clean documents; a misspelled hit
    has a weight of its own only if it rests on enough documents, and none below zero.
    """
    train = training_rows(docs, labels, most, id_col=id_col, text_col=text_col)
    sizes = dict(train.groupBy("toxic").count().collect())
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Model([], [], 1.0, [math.log((toxic + 0.5) / (clean + 0.5)) if toxic + clean else -5.0, 0.0, 0.0, 0.0])
    counts = candidate_terms(train)
    # EVIDENCE needs at least so many toxic documents, and terms that clean ones have as often are of no use.
    least = max(2, math.floor(EVIDENCE / (2 * math.log((toxic + clean) / toxic))))
    likely = counts.where((F.col("t") >= least) & (F.col("t") * clean > MIN_RATIO * F.col("c") * toxic))
    rows = [tuple(r) for r in likely.collect()]
    terms = choose_terms(rows, toxic, clean)
    plain = Model(terms, [(1.0, 1.0)] * len(terms), 1.0, [0.0] * 4)
    found = map_texts(
        train.withColumnRenamed("toxic", "id"), None, "hits array<struct<term:int,edits:int,quoted:boolean>>", id_col="id",
        setup=lambda: (lambda score: lambda data: (sorted(set(score.hits(data))),))(Scorer(plain)),
    )
    seen = found.select(F.col("id").alias("toxic"), "hits").collect()
    by_hit = Counter((h.term, h.edits, r.toxic) for r in seen for h in {(x.term, x.edits): x for x in r.hits}.values())
    weights = []
    for i in range(len(terms)):
        exact, fuzzy = ((by_hit[i, e, 1], by_hit[i, e, 0]) for e in (0, 1))
        own = max(0.0, log_odds(*exact, toxic, clean))
        near = max(0.0, log_odds(*fuzzy, toxic, clean)) if sum(fuzzy) >= SUPPORT else own if not fuzzy[1] else 0.0
        weights.append((own, min(near, own)))
    quotes = Counter((all(h.quoted for h in r.hits), r.toxic) for r in seen if r.hits)
    quoted = 0.5
    if quotes[True, 0] + quotes[True, 1] >= SUPPORT and quotes[False, 1]:
        odds = [log_odds(quotes[q, 1], quotes[q, 0], toxic, clean) for q in (True, False)]
        quoted = min(1.0, max(0.0, odds[0] / odds[1])) if odds[1] > 0 else 0.5
    model = Model(terms, weights, quoted, [0.0] * 4)
    scorer = Scorer(model)
    features = map_texts(
        train.withColumnRenamed("toxic", "id"), None, "f array<double>", id_col="id", setup=lambda: (lambda s: lambda data: (s.features(data),))(Scorer(model))
    ).collect()
    model.coefficients = logistic(np.array([r.f for r in features]), np.array([r.id for r in features], dtype=float))
    return scorer.model


def scorer_of(model: Model) -> Scorer:
    """One scorer for each model and Python worker, so that tasks share what it remembers."""
    return kept_in_worker(("toxicity", repr(model)), lambda: Scorer(model))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, score and predicted of every whole text; nothing but the text is looked at.

    Null and empty texts get the score of a text without hits. Repeated rows each get a
    row; an empty table gives an empty result; no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = map_texts(docs, None, "score double", id_col=id_col, text_col=text_col, setup=lambda: (lambda s: lambda data: (s.score(data),))(scorer_of(shared.value)))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, *, most: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, held_out, score and predicted of every document, by a model fitted here.

    Labels of held-out ids (crc32 of the id as text, modulo 4, is 2) are not read, nor are
    null ones; of several labels of an id the largest counts. Without labels of both kinds
    all scores are the share of toxic ones. A null id counts as the empty text for the
    remainder.
    """
    model = fit(docs, labels, most=most, id_col=id_col, text_col=text_col)
    scored = score(docs, model, id_col=id_col, text_col=text_col)
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, labels: DataFrame, *, most: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that a model fitted on them and the labels doesn't predict as toxic.

    Each row is judged by its text alone, so that null and repeated ids do no harm; null and
    empty texts score as texts without hits. All columns stay, whatever their names; no text
    is shuffled; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, most=most, id_col=id_col, text_col=text_col))

    @F.pandas_udf(DoubleType())
    def scores(texts: pd.Series) -> pd.Series:
        scorer = scorer_of(shared.value)
        return texts.map(lambda x: scorer.score((x or "").encode()))

    return docs.where(scores(F.coalesce(text_col, F.lit(""))) < THRESHOLD)
