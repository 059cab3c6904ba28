"""BPE encoding by a lexicon automaton of frequent words, and decoding."""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspan.llm.automaton import Lexicon, compile_lexicon
from quillspan.llm.text import arrow_schema, kept_in_worker, release_memory, slices
from quillspan.session import materialize

#: A piece is frequent if it is at least this share of all pieces, so that the lexicon holds
#: at most 250,000 of them, whatever the size of the corpus.
FREQUENT = 4e-6
#: Distinct pieces whose ids a Python worker remembers, and as many that it met before these.
REMEMBERED = 200_000
#: Longer texts are normalised in parts that end before a space, which never stands in a piece.
PART = 1 << 20
LONG_PIECE = 256
#: Bytes of a piece up to which it is merged together with others.
SHORT_PIECE = 24
TOGETHER = 2048


# Code points from U+0000 to U+024F that every Unicode version classes alike; all are in
# composed form already, and none is a rare control character.
PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7e\\xa0-\\u024f]*")
LETTERS = "a-zA-Z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u02af\\u2c65\\u2c66"
NUMBERS = "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
#: The pieces of such a text in lower case: the file's own pattern, with the classes written out.
PLAIN_PIECES = re.compile(f"[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[{NUMBERS}]|[^\\s{LETTERS}{NUMBERS}]+")
# The pattern and the normalizers of the files that PLAIN_PIECES stands for.
FILE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
FILE_NORMALIZERS = ["NFC", "Replace", "Lowercase"]


def byte_names() -> dict[int, str]:
    """The character that stands for each byte: itself if it prints, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Rules:
    """Pieces, merges and tokens of a BPE tokenizer file of the tokenizers library."""

    def __init__(self, payload: bytes):
        spec = json.loads(payload)
        model = spec["model"]
        if model["type"] != "BPE" or model["dropout"] or model["byte_fallback"] or model["ignore_merges"] or model["unk_token"]:
            raise ValueError("only plain BPE without unknown tokens is supported")
        if spec["post_processor"] or spec["decoder"]:
            raise ValueError("files with a post-processor or a decoder are not supported")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("only added tokens that are found as they stand are supported")
        cutters = spec["pre_tokenizer"]["pretokenizers"]
        normalizers = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if normalizers != FILE_NORMALIZERS or [x["type"] for x in cutters] != ["Split", "ByteLevel"] or cutters[0]["pattern"] != {"Regex": FILE_PATTERN}:
            raise ValueError("only the pattern and the normalizers above are supported")
        library = Tokenizer.from_buffer(payload)
        self.normalize, self.cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.ids: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        pairs = [tuple(p) for p in pairs]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")").split if self.special else lambda x: [x]
        names = {i: t for t, i in (*self.ids.items(), *self.special.items())}
        self.names = [names.get(i, "") for i in range(max(names, default=-1) + 1)]
        self.shown = byte_names()
        self.bytes_of = {c: bytes([b]) for b, c in self.shown.items()}
        # Tokens have numbers while they merge, so that a pair is one number: its rank, and what it becomes.
        singles = [self.shown[b] for b in range(256)]
        number = {t: i for i, t in enumerate(dict.fromkeys([*singles, *(t + self.suffix for t in singles), *chain.from_iterable((a, b, a + b) for a, b in pairs)]))}
        self.ranks = {number[a] << 32 | number[b]: i for i, (a, b) in enumerate(pairs)}
        self.made = [number[a + b] for a, b in pairs]
        self.begin, self.last = [number[t] for t in singles], [number[t + self.suffix] for t in singles]
        self.id_of = [self.ids.get(t) for t in number]
        self.arrays = [np.array([-1 if x is None else x for x in xs], dtype=np.int64) for xs in (self.begin, self.last, self.made, self.id_of)]
        found = sorted(self.ranks.items())
        self.sorted_pairs, self.sorted_ranks = (np.array([x[k] for x in found], dtype=np.int64) for k in range(2))

    def pieces(self, text: str) -> Iterator[tuple[str | None, list[str]]]:
        """Added tokens as (token, []) and what lies between them as (None, pieces).

        A text of plain code points is cut here, any other by the library's own parts.
        """
        plain = PLAIN.fullmatch(text)
        for i, part in enumerate(self.split(text)):
            if i % 2:
                yield part, []
                continue
            begin = 0
            while begin < len(part):
                end = len(part) if len(part) - begin <= PART else part.find(" ", begin + PART)
                end = len(part) if end < 0 else end
                if plain:
                    yield None, PLAIN_PIECES.findall(part[begin:end].lower())
                else:
                    shown = self.cut(self.normalize(part[begin:end]))
                    yield None, [b"".join(map(self.bytes_of.__getitem__, p)).decode() for p, _ in shown]
                begin = end

    def merge(self, piece: str) -> list[int]:
        """The ids of one piece by merging, lowest rank first and from the left."""
        data = piece.encode()
        tokens = [self.begin[b] for b in data]
        tokens[-1] = self.last[data[-1]]
        if len(tokens) > LONG_PIECE:
            return self.merge_long(tokens)
        get, none = self.ranks.get, len(self.made)
        ranks = [get(a << 32 | b, none) for a, b in pairwise(tokens)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            tokens[i] = made = self.made[best]
            del tokens[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(tokens[i - 1] << 32 | made, none)
            if i < len(ranks):
                ranks[i] = get(made << 32 | tokens[i + 1], none)
        return [x for x in map(self.id_of.__getitem__, tokens) if x is not None]

    def merge_all(self, pieces: list[str]) -> list[list[int]]:
        """``merge`` of many pieces; short ones of about one length take their next merges together."""
        data = [p.encode() for p in pieces]
        order = sorted(range(len(data)), key=lambda i: len(data[i]))
        n_short = bisect_right(order, SHORT_PIECE, key=lambda i: len(data[i])) if self.made else 0
        out: list[list[int]] = [[]] * len(data)
        for begin in range(0, n_short, TOGETHER):
            own = order[begin : min(n_short, begin + TOGETHER)]
            for i, ids in zip(own, self.merge_short([data[i] for i in own])):
                out[i] = ids
        for i in order[n_short:]:
            out[i] = self.merge(pieces[i])
        return out

    def merge_short(self, data: list[bytes]) -> list[list[int]]:
        """A row of tokens for each piece, and the ranks of the pairs in it."""
        sizes = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
        flat = np.frombuffer(b"".join(data), dtype=np.uint8)
        places, none = np.arange(int(sizes.max()) + 1), len(self.made)
        begin, last, made = self.arrays[:3]
        tokens = np.full((len(data), len(places)), -1, dtype=np.int64)
        tokens[places < sizes[:, None]] = begin[flat]
        tokens[np.arange(len(data)), sizes - 1] = last[flat[np.cumsum(sizes) - 1]]

        def rank(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            keys = np.where((a < 0) | (b < 0), -1, a << 32 | b)
            at = np.minimum(np.searchsorted(self.sorted_pairs, keys), len(self.sorted_pairs) - 1)
            return np.where(self.sorted_pairs[at] == keys, self.sorted_ranks[at], none)

        live, t = np.arange(len(data)), tokens
        r = rank(t[:, :-1], t[:, 1:])
        while True:
            i = r.argmin(axis=1)
            best = r[np.arange(len(r)), i]
            go = best < none
            tokens[live[~go], : t.shape[1]] = t[~go]
            live, t, r, i, best = live[go], t[go], r[go], i[go], best[go]
            if not len(live):
                break
            # The token behind the pair goes, and what follows moves up.
            row, column = np.arange(len(live)), places[: t.shape[1]]
            t = np.take_along_axis(t, np.minimum(column + (column > i[:, None]), t.shape[1] - 1), 1)
            r = np.take_along_axis(r, np.minimum(column[:-1] + (column[:-1] >= i[:, None]), r.shape[1] - 1), 1)
            t[:, -1], r[:, -1] = -1, none
            t[row, i] = made[best]
            before = np.maximum(i - 1, 0)
            r[row, before] = np.where(i > 0, rank(t[row, before], t[row, i]), r[row, before])
            r[row, i] = rank(t[row, i], t[row, i + 1])
        ids = self.arrays[3][tokens]
        ids[tokens < 0] = -1
        ends = [0, *np.cumsum((ids >= 0).sum(axis=1)).tolist()]
        kept = ids[ids >= 0].tolist()
        return [kept[a:b] for a, b in zip(ends, ends[1:])]

    def merge_long(self, tokens: list[int]) -> list[int]:
        """The same with a heap of pairs, for pieces in which looking over all pairs costs too much."""
        get, n = self.ranks.get, len(tokens)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, tokens[i], tokens[i + 1]) for i in range(n - 1) if (r := get(tokens[i] << 32 | tokens[i + 1])) is not None]
        heapify(heap)
        alive: list[int | None] = list(tokens)
        while heap:
            rank, i, a, b = heappop(heap)
            j = after[i]
            if alive[i] != a or j >= n or alive[j] != b:
                continue
            alive[i], alive[j] = self.made[rank], None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y < n and (r := get(alive[x] << 32 | alive[y])) is not None:
                    heappush(heap, (r, x, alive[x], alive[y]))
        return [x for t in alive if t is not None and (x := self.id_of[t]) is not None]

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by spaces: what the library does where a file has no decoder."""
        return " ".join(map(self.names.__getitem__, ids))


class Encoder:
    """Encodes texts: pieces that the lexicon has come from it, all others are merged."""

    def __init__(self, rules: Rules, lexicon: Lexicon):
        self.rules, self.lexicon = rules, lexicon
        self.known: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}

    def learn(self, pieces: set[str]) -> None:
        """Pieces that are met again outlive the ``REMEMBERED`` that come after them."""
        new = pieces - self.known.keys()
        if len(self.known) + len(new) > REMEMBERED:
            self.known, self.older, new = {}, self.known, pieces
        if self.older:
            self.known.update((p, self.older[p]) for p in new & self.older.keys())
            new -= self.older.keys()
        if new:
            new = list(new)
            places = self.lexicon.places([p.encode() for p in new]).tolist()
            rare = [p for p, place in zip(new, places) if place < 0]
            self.known.update((p, self.lexicon.outputs(place)) for p, place in zip(new, places) if place >= 0)
            self.known.update(zip(rare, self.rules.merge_all(rare)))

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text; the pieces of all are looked up together."""
        cut = [list(self.rules.pieces(x)) for x in texts]
        self.learn({p for parts in cut for _, pieces in parts for p in pieces})
        out = []
        for parts in cut:
            ids: list[int] = []
            for token, pieces in parts:
                if token is not None:
                    ids.append(self.rules.special[token])
                ids += chain.from_iterable(map(self.known.__getitem__, pieces))
            out.append(ids)
        return out


def frequent_pieces(docs: DataFrame, payload: bytes, *, text_col: str = "text", share: float = FREQUENT) -> list[str]:
    """Pieces that are at least ``share`` of all pieces of the corpus: at most 1 / share."""
    out = "piece string, n long"
    texts = docs.select(F.coalesce(text_col, F.lit("")).alias("text"))
    arrow = arrow_schema(texts, out)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, counts = kept_in_worker(("bpe", payload), lambda: Rules(payload)), Counter()

        def counted():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], schema=arrow)

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for _, pieces in rules.pieces(text):
                    counts.update(pieces)
                if len(counts) > REMEMBERED:
                    yield counted()
                    counts.clear()
        if counts:
            yield counted()
        del counts
        release_memory()

    counts = materialize(texts.mapInArrow(count, out).groupBy("piece").agg(F.sum("n").alias("n")), "pieces")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return [r.piece for r in counts.where(F.col("n") >= max(2, share * total)).select("piece").collect()]


def encode_decode(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", share: float = FREQUENT) -> DataFrame:
    """The id, ``ids`` (array<int>) and ``decoded`` of every whole text.

    Ids are those of the tokenizers library without added begin or end tokens; strings of
    added tokens inside a text become their ids. Frequent pieces of the corpus are merged
    once on the driver and compiled, with their ids, into a minimal automaton of at most
    1 / ``share`` words; each Python worker maps its file. Results do not depend on which
    pieces are in it. Null and empty texts: no ids and an empty decoded text. Repeated
    rows each get a row; an empty table gives an empty result; columns other than the id
    and the text are not read. Texts do not go through a shuffle.
    """
    with open(tokenizer_path, "rb") as f:
        payload = f.read()
    rules = Rules(payload)
    words = sorted((p.encode(), p) for p in frequent_pieces(docs, payload, text_col=text_col, share=share))
    lexicon = compile_lexicon([w for w, _ in words], rules.merge_all([p for _, p in words]))
    shared = docs.sparkSession.sparkContext.broadcast((payload, lexicon))
    id_type = docs.schema[id_col].dataType.simpleString()
    out = f"{id_col} {id_type}, ids array<int>, decoded string"
    texts = docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("text"))
    arrow = arrow_schema(texts, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(kept_in_worker(("bpe", shared.value[0]), lambda: Rules(shared.value[0])), Lexicon.of_bytes(shared.value[1]))
            begin = 0
            for part in slices(batch.column(1).to_pylist(), PART):
                ids = encoder.encode(part)
                columns = [
                    batch.column(0).slice(begin, len(part)).cast(arrow.field(0).type),
                    pa.array(ids, arrow.field(1).type),
                    pa.array(list(map(encoder.rules.decode, ids)), pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)
                begin += len(part)
        del encoder
        release_memory()

    return texts.mapInArrow(run, out)


def digests(encoded: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """The id, the number of tokens, and digests of the ids and of the decoded text."""
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
