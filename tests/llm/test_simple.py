"""Token counts, quality rules, BPE and scores of n-grams against plain code."""

import hashlib
import math
import re
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillspan.llm import automaton, backoff, bpe, quality, tokencount

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def by_row(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.na.fill({"doc_id": -1}).collect())


def test_token_counts(spark, docs, rows, none, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = sorted((-1 if i is None else i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in rows)
    cache = str(tmp_path / "cache")
    for _ in range(2):  # cold, then from the cache
        assert by_row(tokencount.count_tokens(docs, path, cache), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for _, t in rows})
    assert tokencount.count_tokens(none, path, str(tmp_path / "none")).count() == 0


def test_token_counts_of_sentencepiece(spark, docs, rows, tmp_path):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    want = sorted((-1 if i is None else i, len(model.encode(t or ""))) for i, t in rows)
    assert by_row(tokencount.count_tokens(docs, path, str(tmp_path)), "doc_id", "n_tokens") == want


def plain_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside), len(words) < 10 or 100 * len(inside) > 20 * len(words)


def test_quality(docs, rows, none):
    want = sorted((-1 if i is None else i, *plain_quality(t)) for i, t in rows)
    got = quality.quality(docs)
    assert by_row(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert all(not r.kept for r in got.collect() if r.base_failed) and quality.quality(none).count() == 0


def plain_kept(text):
    """The verdict by plain rules: bands of whole texts and of pieces of 4096 bytes."""
    import zstandard

    data = (text or "").encode()
    ratio = lambda x: len(zstandard.compress(x, 3)) / len(x)

    def side(x):
        frame = zstandard.ZstdCompressor(level=3, write_content_size=False).compress(x)
        low, high = next((low, high) for below, low, high in quality.BANDS if len(x) < below)
        return "low" if low is not None and len(frame) / len(x) < low else "high" if high is not None and len(frame) / len(x) > high else ""

    if plain_quality(text)[-1]:
        return False
    bytes_of = Counter()
    for i in range(0, len(data), 4096):
        bytes_of[side(data[i : i + 4096])] += len(data[i : i + 4096])
    return not side(data) and 2 * max(bytes_of["low"], bytes_of["high"]) <= len(data) and abs(ratio(data)) > 0


def test_quality_verdict(spark, rows):
    """Every column of the verdict against plain rules, with last chunks of all sizes."""
    import base64
    import random

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8)))
    prose = " ".join(word() for _ in range(4000))
    junk = " ".join(base64.b64encode(rng.randbytes(6)).decode() for _ in range(2000))
    same = " ".join(f"{w} x" for w in ["ab"] * 3) + " "
    texts = [t for _, t in rows]
    for cut in (30, 60, 100, 120, 700, 3000, 4090, 4097, 4200, 6000, 8000, 8193, 12_000):
        texts += [prose[:cut], junk[:cut], prose[: cut // 2] + " " + junk[: cut // 2], (same * 2000)[:cut], prose[:200] + " " * cut]
    got = quality.quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.kept for r in got] == [plain_kept(t) for t in texts]
    assert 10 < sum(r.kept for r in got) < len(texts) - 10 and any(not r.kept and not r.base_failed for r in got)


def test_quality_bands():
    import random

    rng = random.Random(1)
    prose = " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(2000))
    kept = lambda text: quality.measure()(text.encode("latin-1"))[-1]
    assert kept(prose)
    assert not kept(" ".join(f"w{i}" for i in range(12)) + " " + "ab" * 20_000)
    assert not kept(" ".join("".join(chr(rng.randrange(33, 255)) for _ in range(9)) for _ in range(2000)))


@pytest.mark.parametrize("n", [120, 180, 250, 500, 1000, 2000, 4000, 20_000])
def test_quality_rejects_incompressible_utf8(n):
    import base64
    import random

    rng = random.Random(n)
    prose = " ".join("".join(rng.choice("eeeetttaaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(n))
    spaced = lambda text: (" ".join(text[i : i + 8] for i in range(0, len(text), 8))).encode()[:n].decode("utf-8", "ignore")
    junk = {
        "base64": spaced(base64.b64encode(rng.randbytes(n)).decode()),
        "latin": spaced("".join(map(chr, rng.choices([*range(33, 127), *range(161, 256)], k=n)))),
        "ascii": spaced("".join(chr(rng.randrange(33, 127)) for _ in range(n))),
    }
    kept = lambda text: quality.measure()(text.encode())[-1]
    assert kept(prose[:n]) and not any(map(kept, junk.values()))
    assert all(len(text.split()) >= quality.MIN_WORDS for text in junk.values())


def test_quality_rejects_incompressible_chunks():
    import base64
    import random

    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    prose = " ".join(rng.choice(vocabulary) for _ in range(3000))[:12_000]
    data = (prose + "\n".join(base64.b64encode(rng.randbytes(57)).decode() for _ in range(230))).encode()
    row = quality.measure()(data)
    assert row[8] * quality.CHUNK_BYTES > len(data) / 2 and row[5] < 0.7 and not row[-1]


def test_lexicon_is_minimal_and_exact():
    words = sorted({f"{a}{b}ing".encode() for a in ("walk", "talk", "st", "") for b in ("", "er", "ers")} | {b"walk", b"a"})
    data = automaton.compile_lexicon(words, [[i, i + 1] for i in range(len(words))])
    found = automaton.Lexicon.of_bytes(data)
    assert found.places(words).tolist() == list(range(len(words)))
    assert found.places([b"", b"wal", b"walkx", b"zz", b"ing" * 9]).tolist() == [-1] * 5
    assert found.outputs(3) == [3, 4]
    assert len(found.finals) < sum(map(len, words)) / 3  # shared suffixes
    assert automaton.Lexicon.of_bytes(automaton.compile_lexicon([], [])).places([b"a", b""]).tolist() == [-1, -1]


@pytest.mark.parametrize("share", [4e-6, 0.01, 2.0])
def test_bpe_equals_library(spark, docs, rows, none, share):
    special = spark.createDataFrame([(500, "a<|endoftext|>b <|startoftext|> it's 12½ x²"), (501, "ab" * 900)], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(special)
    library = Tokenizer.from_file(WORD_BPE)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for i, t in [*rows, *[tuple(r) for r in special.collect()]]:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((-1 if i is None else i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    got = bpe.digests(bpe.encode_decode(both, WORD_BPE, share=share))
    assert by_row(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want)
    assert bpe.encode_decode(none, WORD_BPE).count() == 0


@pytest.mark.parametrize("order, block, bucket", [(3, 1 << 20, 1 << 20), (4, 9000, 5000)])
def test_backoff(docs, rows, none, order, block, bucket):
    """Every document against the counts of all others, at several orders and sizes of blocks and buckets."""
    texts = [(i, (t or "").encode().lower().split()) for i, t in rows]
    at = lambda w, p, k: tuple(([None] * order + w)[p + order - k + 1 : p + order + 1])
    own = [Counter((k, *at(w, p, k)) for p in range(len(w)) for k in range(1, order + 1)) for _, w in texts]
    before = [Counter((k, *at(w, p, k)[:-1]) for p in range(len(w)) for k in range(1, order + 1)) for _, w in texts]
    grams, contexts = Counter(), Counter()
    for mine, met in zip(own, before):
        grams.update(mine)
        contexts.update(met)
    want, total = [], sum(len(x) for _, x in texts)
    for (i, w), mine, met in zip(texts, own, before):
        back, s = 0, 0.0
        for p in range(len(w)):
            k = order
            while k and grams[k, *at(w, p, k)] == mine[k, *at(w, p, k)]:
                k -= 1
            back += k < order
            key = (k, *at(w, p, k)[:-1])
            share = (grams[k, *at(w, p, k)] - mine[k, *at(w, p, k)]) / (contexts[key] - met[key]) if k else 1 / (total - len(w))
            s += (order - k) * math.log(0.4) + math.log(share)
        want.append((-1 if i is None else i, len(w), back, round(s, 6) + 0.0))
    got = backoff.backoff_scores(docs, order=order, block=block, bucket=bucket).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_backoff, round(r.log_score, 6) + 0.0) for r in got) == sorted(want)
    assert all((r.mean_log_score is None) == (r.n_tokens == 0) for r in got)
    if order == 3:
        assert backoff.backoff_scores(none).count() == 0


def test_backoff_of_a_single_text(spark):
    got = backoff.backoff_scores(spark.createDataFrame([(1, "Some words, some"), (None, None)], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_tokens, r.n_backoff, round(r.log_score, 9)) for r in got} == {(1, 3, 3, round(9 * math.log(0.4), 9)), (None, 0, 0, 0.0)}


def odd_texts(n):
    """Random texts of all kinds of white space, control characters, added tokens and composed characters."""
    import random

    rng = random.Random(n)
    some = [*"ab 1.,'\n\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0 ᠎​ 　́é東🙂\x00Σς", "  ", "'s", "<|endoftext|>", "<|startoftext|>", "İ", "word "]
    return ["".join(rng.choice(some) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_token_counts_by_parts():
    """The library gets a part that is met often once, and counts are those of whole texts."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    with open(path, "rb") as f:
        payload = f.read()
    texts = odd_texts(3000)
    count = tokencount.counter("byte_bpe_50k.json", payload)
    for _ in range(2):
        assert count(texts) == [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]
    given = []

    def whole(some):
        given.extend(some)
        return [len(library.encode(x, add_special_tokens=False).ids) for x in some]

    often = [" ".join(["again"] * 50) + f" only{i}" for i in range(20)]
    want = whole(often)
    del given[:]
    assert tokencount.by_parts(whole)(often) == want and sum(map(len, given)) < sum(map(len, often)) / 10
    assert tokencount.by_parts(whole, most=1)(often) == want


def test_bpe_merges_together():
    """Pieces that are merged together have the ids of the library, whatever their lengths."""
    library = Tokenizer.from_file(WORD_BPE)
    with open(WORD_BPE, "rb") as f:
        rules = bpe.Rules(f.read())
    texts = [*odd_texts(3000), "ab" * 11 + "c", "ab" * 12, "ab" * 13, "é東" * 300, "x" * 3000]
    pieces = sorted({p for t in texts for _, part in rules.pieces(t) for p in part})
    assert rules.merge_all(pieces) == [rules.merge(p) for p in pieces] and rules.merge_all([]) == []
    encoder = bpe.Encoder(rules, automaton.Lexicon.of_bytes(automaton.compile_lexicon([], [])))
    assert encoder.encode(texts) == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
