"""Text helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Words of letters and digits: ASCII ones, and every code point from U+0080 on.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between words, in either case. Java looks up single characters in a table, and tries ranges one by one.
BETWEEN = "[" + "".join(f"\\x{c:02x}" for c in range(128) if not chr(c).isalnum()) + "]+"
#: Words over lower-cased UTF-8 bytes.
WORD_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null becomes the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words_column(text: Column) -> Column:
    """The array of words of a text."""
    return F.regexp_extract_all(lower_ascii(text), F.lit(WORD_PATTERN), F.lit(0))


def split_words(text: Column) -> Column:
    """The array of words of a text in their own case; each lower-cased by ``lower_word``, they are those of ``words_column``."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def lower_word(word: Column) -> Column:
    """Lower-case A-Z and nothing else; words of ASCII alone take the quick way. Null stays null."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def map_texts(
    docs: DataFrame,
    per_text: Callable[[bytes], tuple],
    schema: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    setup: Callable[[], Callable[[bytes], tuple]] | None = None,
) -> DataFrame:
    """Apply a function of one text's UTF-8 bytes to every row, in Arrow batches.

    ``schema`` names the columns after the id. With ``setup``, the function is made once
    per task. A null text counts as empty; ids pass through unchanged.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    full = f"{id_col} {id_type}, {schema}"
    arrow = arrow_schema(docs.select(id_col).limit(0), full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = setup() if setup else per_text
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [f(b or b"") for b in batch.column(1).cast(pa.binary()).to_pylist()]
            columns = [pa.array(c, type=k.type) for c, k in zip(zip(*rows), list(arrow)[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field(0).type), *columns], schema=arrow)

    return docs.select(id_col, text_col).mapInArrow(run, full)


def arrow_schema(like: DataFrame, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def release_memory() -> None:
    """Give what a Python worker has freed back to the system, as workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_KEPT: dict[tuple, object] = {}


def kept_in_worker(key: tuple, make: Callable[[], object]) -> object:
    """What ``make`` gives, kept for later tasks of this Python worker until another key is asked for."""
    if key not in _KEPT:
        _KEPT.clear()
        release_memory()
        _KEPT[key] = make()
    return _KEPT[key]


def slices(texts: list, most: int = 1 << 20) -> Iterator[list]:
    """Consecutive texts in slices of about ``most`` characters, so that encodings stay small."""
    part, size = [], 0
    for x in texts:
        part.append(x)
        size += len(x)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def split_join(rows: DataFrame, by_key: DataFrame, key: str, count: str, *, most: int = 10_000) -> DataFrame:
    """The inner join of ``rows`` with one row a key, of which column ``count`` says how many ``rows`` it has.

    Keys with more than 1 / ``most`` of all rows are ``most`` at most, so that they are
    broadcast and their rows stay where they are; the others are joined by a shuffle.
    """
    total = by_key.agg(F.sum(count)).first()[0] or 0
    limit = max(most, total // most)
    hot, cold = by_key.where(F.col(count) > limit), by_key.where(F.col(count) <= limit)
    if hot.isEmpty():
        return rows.join(cold, key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rest.join(cold, key).unionByName(rows.join(F.broadcast(hot), key))
