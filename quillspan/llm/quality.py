"""Quality rules: zstandard compression bands over whole texts and over fixed chunks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import zstandard
from pyspark.sql import DataFrame

from quillspan.llm.text import map_texts

#: (UTF-8 bytes below, lowest ratio, highest ratio) of compressed to raw bytes, for texts and
#: chunks of that length. The highest lie between prose and base64, random CJK or Latin-1 as
#: UTF-8. Below 112 bytes prose and random text have the same ratios (0.8 to 1.2), so that a
#: highest one there would only tell lengths apart; repeated text lies lower.
BANDS = (
    (64, 0.60, None),
    (112, 0.45, None),
    (128, 0.35, 0.99),
    (192, 0.27, 0.94),
    (256, 0.27, 0.88),
    (512, 0.33, 0.79),
    (1024, 0.30, 0.74),
    (2048, 0.26, 0.73),
    (4096, 0.26, 0.70),
    (float("inf"), 0.20, 0.70),
)
CHUNK_BYTES = 4096
#: Share of a text's bytes in chunks outside their bands, on the same side, that rejects it.
CHUNK_SHARE = 0.5
LEVEL = 3

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
MIN_WORDS = 10
WINDOW = 5

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "ratio double, n_chunks long, n_low_chunks long, n_high_chunks long, base_failed boolean, kept boolean"
)


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside a window of ``window`` words that stands in the text twice or more."""
    if len(words) <= window:
        return 0
    grams = list(zip(*(words[i:] for i in range(window))))
    counts = Counter(grams)
    if len(counts) == len(grams):
        return 0
    covered, end = 0, 0
    for i, gram in enumerate(grams):
        if counts[gram] > 1:
            covered += i + window - max(i, end)
            end = i + window
    return covered


def dup_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def band(n_bytes: int) -> tuple[float | None, float | None]:
    return next((low, high) for below, low, high in BANDS if n_bytes < below)


def side(n_bytes: int, ratio: float) -> int:
    """-1 below the band of that length, 1 above it, else 0."""
    low, high = band(n_bytes)
    return -1 if low is not None and ratio < low else 1 if high is not None and ratio > high else 0


def measure() -> Callable[[bytes], tuple]:
    """The function of one text that gives the columns of ``SCHEMA``."""
    squeeze = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False).compress

    def of(data: bytes) -> tuple:
        text = data.decode("utf-8", "replace")
        words = data.split()
        n = len(words)
        repeated = repeat_words(words)
        ratio = len(squeeze(data)) / len(data) if data else None
        chunks = [data[i : i + CHUNK_BYTES] for i in range(0, len(data), CHUNK_BYTES)]
        sides = [side(len(c), len(squeeze(c)) / len(c)) for c in chunks] if len(chunks) > 1 else [side(len(c), ratio) for c in chunks]
        low, high = sides.count(-1), sides.count(1)
        in_side = [sum(len(c) for c, s in zip(chunks, sides) if s == way) for way in (-1, 1)]
        outside = bool(data) and (side(len(data), ratio) != 0 or max(in_side) > CHUNK_SHARE * len(data))
        failed = n < MIN_WORDS or 100 * repeated > 20 * n
        return (
            n,
            len(text) - sum(map(text.count, SPACES)),
            sum(map(text.count, SYMBOLS)),
            dup_lines(data),
            repeated,
            ratio,
            len(chunks),
            low,
            high,
            failed,
            not failed and not outside,
        )

    return of


def quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, compression ratios and a verdict for every document; no shuffle.

    A text is rejected when its ratio leaves the band for its length, or when chunks with
    more than half of its bytes leave the bands for their length (that of the last one is
    its own) on the same side, or by the base rules
    (fewer than ten words; over a fifth of its words in repeated windows of five words).
    Null and empty texts: all counts 0, ratio null, base_failed true. Very long texts are
    measured whole. Repeated rows each get a row. An empty table gives an empty result.
    Only the id and the text are read, so other columns may have any names.
    """
    return map_texts(docs, None, SCHEMA, id_col=id_col, text_col=text_col, setup=measure)
