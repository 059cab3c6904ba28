"""Near-duplicates, line dedup and suffix dedup against plain code."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillspan.llm import inducedsort, linededup, simhash, suffixdedup


def plain_fingerprint(text):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", w) if x]
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps):
    root = list(range(len(fps)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[top(i)] = top(j)
    return [top(i) for i in range(len(fps))]


@pytest.mark.parametrize("bucket", [1024, 2])
def test_simhash(docs, rows, none, bucket):
    fps = [plain_fingerprint(t) for _, t in rows]
    comps = components(fps)
    least = {}
    for (i, _), c in zip(rows, comps):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    want = sorted((-1 if i is None else i, f"{f:016x}", least.get(c)) for (i, _), f, c in zip(rows, fps, comps))
    got = simhash.near_duplicates(docs, bucket=bucket).na.fill({"doc_id": -1})
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got.collect()) == want
    if bucket > 2:
        assert simhash.near_duplicates(none).count() == 0
        groups = {c: min((i is None, i or 0) for (i, _), d in zip(rows, comps) if d == c) for c in comps}
        kept = simhash.keep_first(docs)
        assert kept.columns == docs.columns and sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted(groups.values())
        assert simhash.keep_first(none).count() == 0


def test_pivot_tables_bring_candidates(spark, monkeypatch):
    """Links come from coordinates: without references all values share a key, with them few do."""
    rng = random.Random(9)
    fps = [rng.getrandbits(64) for _ in range(300)]
    fps += [x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for x in fps[:60]]
    df = spark.createDataFrame([(simhash.signed(x),) for x in set(fps)], "fp long")
    met = df.select(F.explode(F.array(*(F.lit(simhash.signed(m)) for m in simhash.finer_masks(0, 5, 3)))).alias("mask"), "fp")
    keyed = met.select("mask", simhash.pivot_key(F.col("fp"), F.col("mask")).alias("key"), "fp")
    sizes = [r["count"] for r in keyed.groupBy("mask", "key").count().collect()]
    assert max(sizes) <= 4 and sum(n > 1 for n in sizes) >= 60
    want = {frozenset((x, y)) for x in fps for y in fps if x != y and (x ^ y).bit_count() <= 3}
    got = {frozenset((r.a % (1 << 64), r.b % (1 << 64))) for r in simhash.fingerprint_links(df).collect()}
    assert got <= want and {x for p in got for x in p} == {x for p in want for x in p}


def test_every_close_pair_shares_a_key():
    rng = random.Random(2)
    masks, blocks = [0], 5
    for _ in range(4):
        masks = [rng.choice(masks)]
        finer = simhash.finer_masks(masks[0], blocks, 3)
        for _ in range(300):
            x = rng.getrandbits(64)
            free = [b for b in range(64) if not masks[0] >> b & 1]
            y = x
            for b in rng.sample(free, 3):
                y ^= 1 << b
            assert any(x & m == y & m for m in finer)
        masks, blocks = finer, 6


def within_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


LINES = ["the quick brown fox jumps", "the quick brown fox jumped", "the quick brown fox jump", "The quick brown fox jumps", "he quick brown fox jumps", "the quick brwn fox jumps",
         "aaaaaaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaaaaab", "short", "shorx", "  the quick brown fox jumps  ", "é" * 16, "é" * 17, "visit page 1 of the site", "visit page 2 of the site", "visit page 33 of the site"]


def test_line_dedup(spark, docs, rows, none):
    rng = random.Random(1)
    more = [(1000 + i, "\n".join(rng.choice(LINES) for _ in range(rng.randint(1, 5)))) for i in range(25)]
    every = [*rows, *more]
    short = [(2000 + i, t) for i, t in enumerate(["short line one", "short line onf", "a", "b", "ab", "abc", "xyz", "a", "xyzz"])]
    more += short
    every = [*rows, *more]
    key = lambda i, n: ((i is not None, i or 0), n)
    first = {}
    for i, t in every:
        for n, line in enumerate((t or "").split("\n")):
            s = line.strip()
            if s:
                first[s] = min(first.get(s, key(i, n)), key(i, n))
    near = {s for s in first if any(within_one(s, o) and first[o] < first[s] for o in first if abs(len(o) - len(s)) < 2)}
    want = []
    for i, t in every:
        kept, exact, close = [], 0, 0
        for n, line in enumerate((t or "").split("\n")):
            s = line.strip()
            if s and first[s] != key(i, n):
                exact += 1
            elif s in near:
                close += 1
            else:
                kept.append(line)
        want.append((-1 if i is None else i, exact, close, None if t is None else "\n".join(kept)))
    extra = spark.createDataFrame([(i, t, "k", 0, 1.5, "w") for i, t in more], docs.schema)
    got = linededup.dedup_lines(docs.union(extra))
    assert set(docs.columns) < set(got.columns)
    order = lambda r: tuple("" if x is None else str(x) for x in r)
    assert sorted(((r.doc_id if r.doc_id is not None else -1, r.n_exact, r.n_near, r.text) for r in got.collect()), key=order) == sorted(want, key=order)
    assert linededup.dedup_lines(none).count() == 0
    assert linededup.clean_documents(docs).columns == docs.columns


def plain_repeats(text, length):
    seen = Counter(text[i : i + length].tobytes() for i in range(len(text) - length + 1))
    return [i + length <= len(text) and seen[text[i : i + length].tobytes()] > 1 for i in range(len(text))]


@pytest.mark.parametrize("memory", [1_000_000, 3])
def test_induced_sorting(tmp_path, memory):
    """With a memory of 3 all queues spill and the reduced texts are sorted by recursion."""
    rng = random.Random(4)
    for _ in range(60):
        n, kinds, length = rng.randint(1, 90), rng.randint(1, 5), rng.randint(1, 8)
        text = np.array([rng.randrange(kinds) for _ in range(n)], dtype=np.uint16)
        if n > 20:
            text[n // 2 : n // 2 + n // 3] = text[: n // 3]
        assert inducedsort.repeats(text, length, str(tmp_path), memory=memory, reduced=memory).tolist() == plain_repeats(text, length)
    assert not list(tmp_path.iterdir())


def test_queues_spill_at_the_default_memory(tmp_path, monkeypatch):
    """The queues of a shard of usual size are on disk; only the reduced text is sorted in memory."""
    rng, length, met = np.random.default_rng(7), 400, []
    text = rng.integers(1, 5, 700_000).astype(np.uint16)
    text[400_000:401_000] = text[100_000:101_000]
    push, plain = inducedsort.BucketQueues.push, inducedsort.sort_in_memory
    monkeypatch.setattr(inducedsort.BucketQueues, "push", lambda q, s, e: (push(q, s, e), met.append(len(q.on_disk)))[0])
    monkeypatch.setattr(inducedsort, "sort_in_memory", lambda names, longest: (met.append(-len(names)), plain(names, longest))[1])
    found = np.flatnonzero(inducedsort.repeats(text, length, str(tmp_path)))
    assert found.tolist() == [*range(100_000, 100_601), *range(400_000, 400_601)]
    assert max(met) > 1 and -len(text) / 2 < min(met) < 0 and suffixdedup.SHARD > 5 * inducedsort.MEMORY


@pytest.mark.parametrize(("hot", "shard", "length"), [(4000, 1 << 22, 60), (2, 1, 60), (suffixdedup.HOT, suffixdedup.SHARD, suffixdedup.LENGTH)])
def test_suffix_dedup(docs, rows, none, hot, shard, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(d[s : s + length] for _, d in data for s in range(len(d) - length + 1))
    want = []
    for i, d in data:
        gone = bytearray(len(d))
        for s in range(len(d) - length + 1):
            if seen[d[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone) if not g)
        runs = sum(1 for j in range(len(d)) if gone[j] and (j == 0 or not gone[j - 1]))
        want.append((-1 if i is None else i, len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    got = suffixdedup.digests(suffixdedup.remove_repeats(docs, length=length, hot=hot, shard=shard)).na.fill({"doc_id": -1})
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    if hot == 4000:
        assert suffixdedup.remove_repeats(none).count() == 0


@pytest.mark.parametrize(("ids", "dropped"), [((None, 5), 1), ((5, None), 1), ((None, None), 1), ((5, 5), 1), ((4, 5), 1)])
def test_line_dedup_by_ids(spark, ids, dropped):
    """Null and equal ids order documents like any others, and no column name is in the way."""
    line = "the quick brown fox jumps over it"
    rows = [(ids[0], line, "a", 1), (ids[1], line + "!", "b", 2), (9, "another line of its own", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id string, drop_lines int")
    got = linededup.dedup_lines(docs).collect()
    assert sum(r.n_near for r in got) == dropped and sorted(len(r.text) for r in got)[:2] == [0, 23]
    assert {(r["__id"], r.drop_lines) for r in got} == {("a", 1), ("b", 2), (None, None)}
    if None in ids and 5 in ids:
        assert {r.doc_id: r.text for r in got}[None] != ""


def test_keep_first_with_null_and_repeated_ids(spark):
    text = "alone in its group as no other text has these words"
    rows = [(None, text), (None, text), (None, "a second text that nothing else is like at all"), (3, "copied text with a few words"), (None, "copied text with a few words"), (4, "another one")]
    rows += [(9, "one of two texts of an id"), (9, "copied text with a few words"), (4, "another one")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, row_of_docs int")
    got = simhash.keep_first(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == sorted([(0, text), (0, rows[2][1]), rows[3], rows[5], rows[6]])
