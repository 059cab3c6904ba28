"""Benchmark decontamination over a positional inverted index, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.text import free_name, lower_word, split_words, words_column
from quillspan.session import materialize

WINDOW_WORDS = 13
#: Words beyond an item's length that a near match may reach, and the share of its terms that it holds.
SLOP = 8
SHARE = 0.8
#: Rows of a table of terms or row ids up to which it is broadcast; beyond, it is shuffled.
BROADCAST_ROWS = 1_000_000


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if it has at most ``most`` rows; otherwise left to a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("shuffle_merge")


def item_tokens(items: DataFrame, *, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_key, item_id, n, ipos, term): words of the distinct items, positions from 0.

    Items with equal ids and unequal texts stay apart by ``item_key``.
    """
    keyed = items.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text")).distinct()
    keyed = materialize(keyed.select(F.monotonically_increasing_id().alias("item_key"), "item_id", words_column(F.col("text")).alias("words")), "items")
    return keyed.select("item_key", "item_id", F.size("words").alias("n"), F.posexplode("words").alias("ipos", "term"))


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (row_id, doc_id, pos, term) of every word, stored in the shared folder, for any test items.

    Each document also has one row with a null term, whose pos is its number of words.
    ``row_id`` tells rows apart, so that null and repeated ids do no harm.
    """
    words = docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("doc_id"), split_words(F.col(text_col)).alias("words")
    )
    tokens = words.select("row_id", "doc_id", F.posexplode(F.array_append("words", F.lit(None).cast("string"))).alias("pos", "term"))
    return materialize(tokens.withColumn("term", lower_word(F.col("term"))), "postings")


def own_postings(index: DataFrame, tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The postings (row_id, pos, term) of the items' terms, and the tokens, with numbers for terms.

    The whole index is read once for them. Numbers are in the order of the terms, so that
    ties by term fall as they do among strings.
    """
    terms = materialize(tokens.select("term").distinct().orderBy("term").withColumn("number", F.monotonically_increasing_id()), "terms")
    numbered = lambda df: df.join(sized(terms), "term").drop("term").withColumnRenamed("number", "term")
    own = numbered(index.where("term IS NOT NULL").select("row_id", "pos", "term"))
    return materialize(own, "own-postings"), materialize(numbered(tokens), "tokens")


def frequencies(index: DataFrame, tokens: DataFrame) -> DataFrame:
    """(term, freq): how often the items' terms stand in the corpus."""
    own = index.where("term IS NOT NULL").join(sized(tokens.select("term").distinct()), "term", "left_semi")
    return own.groupBy("term").agg(F.count("*").alias("freq"))


def rarest_terms(tokens: DataFrame, index: DataFrame, window: int) -> DataFrame:
    """(item_key, p0, t0, p1, t1, lo, hi): for each window its two rarest terms and its places.

    Windows with a term that no document holds are left out. Windows with the same two
    terms at the same places are one row, from the first place to the last.
    """
    known = tokens.join(frequencies(index, tokens), "term", "left").select("item_key", "n", "ipos", "term", F.coalesce("freq", F.lit(0)).alias("freq"))
    # A token at ipos stands in the windows that begin from ipos - window + 1 to ipos.
    begins = F.sequence(F.greatest(F.lit(0), F.col("ipos") - window + 1), F.greatest(F.lit(0), F.least(F.col("ipos"), F.col("n") - window)))
    in_window = known.select("item_key", F.explode(begins).alias("begin"), F.struct("freq", "ipos", "term").alias("t"))
    by_rarity = in_window.groupBy("item_key", "begin").agg(
        F.sort_array(F.collect_list("t")).alias("ts"), F.min("t.ipos").alias("lo"), F.max("t.ipos").alias("hi")
    )
    first, second = F.col("ts")[0], F.coalesce(F.get("ts", F.lit(1)), F.col("ts")[0])
    return (
        by_rarity.where(first["freq"] > 0)
        .select("item_key", first["ipos"].alias("p0"), first["term"].alias("t0"), second["ipos"].alias("p1"), second["term"].alias("t1"), "lo", "hi")
        .groupBy("item_key", "p0", "t0", "p1", "t1")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    )


def phrase_matches(index: DataFrame, tokens: DataFrame, *, window: int = WINDOW_WORDS) -> DataFrame:
    """(row_id, item_id, first_pos, n): runs of document words that hold whole item windows.

    The postings of a window's rarest term give the offset (document place less item place)
    of each possible occurrence. They are intersected with the postings of its second
    rarest term, moved by that offset, and the rest with those of all other terms. A run
    of at least ``window`` places in a row, or of a whole shorter item, is a match.
    """
    anchors = materialize(rarest_terms(tokens, index, window), "anchors")
    postings = index.join(sized(tokens.select("term").distinct()), "term", "left_semi").select("row_id", "pos", "term")
    rarest = sized(anchors.select("item_key", "p0", F.col("t0").alias("term"), "p1", "t1", "lo", "hi"))
    begun = postings.join(rarest, "term").withColumn("offset", F.col("pos") - F.col("p0"))
    begun = begun.select("row_id", "item_key", "offset", "p1", F.col("t1").alias("term"), (F.col("offset") + F.col("p1")).alias("pos"), "lo", "hi")
    second = postings.join(sized(anchors.select(F.col("t1").alias("term")).distinct()), "term", "left_semi")
    both = begun.join(second, ["row_id", "pos", "term"], "left_semi")
    places = materialize(both.groupBy("row_id", "item_key", "offset").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "offsets")
    wanted = (
        places.join(sized(tokens.select("item_key", "item_id", "n", "ipos", "term")), "item_key")
        .where("ipos BETWEEN lo AND hi")
        .select("row_id", "item_key", "item_id", "n", "offset", "ipos", "term", (F.col("offset") + F.col("ipos")).alias("pos"))
    )
    near = postings.join(sized(places.select("row_id").distinct()), "row_id", "left_semi")
    found = wanted.join(near, ["row_id", "pos", "term"], "left_semi")
    line = Window.partitionBy("row_id", "item_key", "offset").orderBy("ipos")
    runs = (
        found.withColumn("run", F.col("ipos") - F.row_number().over(line))
        .groupBy("row_id", "item_key", "offset", "run")
        .agg(F.first("item_id").alias("item_id"), F.first("n").alias("n_item"), F.min("pos").alias("first_pos"), F.count("*").alias("n"))
    )
    return runs.where(F.col("n") >= F.least(F.col("n_item"), F.lit(window))).select("row_id", "item_id", "first_pos", "n")


def proximity_matches(index: DataFrame, tokens: DataFrame, *, slop: int = SLOP, share: float = SHARE) -> DataFrame:
    """(row_id, item_id, first_pos, last_pos, n_terms): items whose terms stand close, in any order.

    Around a posting of one of an item's rarest terms, within the item's length plus
    ``slop`` words to either side, at least ``share`` of the item's distinct terms occur.
    One more term is tried than may be missing, terms without postings included, so that
    one of them stands in every match. Rows that hold too few of the terms anywhere go
    first; then places meet by bands of a window's length, so that long texts cost in
    proportion to their postings.
    """
    terms = tokens.select("item_key", "term").distinct()
    least = F.ceil(F.lit(share) * F.col("wanted"))
    sizes = tokens.groupBy("item_key", "item_id", "n").agg(F.count_distinct("term").alias("wanted")).withColumn("least", least)
    rarity = Window.partitionBy("item_key").orderBy("freq", "term")
    ranked = terms.join(frequencies(index, tokens), "term", "left").select("item_key", "term", F.coalesce("freq", F.lit(0)).alias("freq")).withColumn("at", F.row_number().over(rarity))
    marked = ranked.join(sizes, "item_key").select("item_key", "term", (F.col("at") <= F.col("wanted") - F.col("least") + 1).alias("rare"))
    marked = materialize(marked, "rarest")
    postings = index.where("term IS NOT NULL").select("row_id", "pos", "term")
    seeds = marked.where("rare").select("item_key", "term")
    begun = postings.join(sized(seeds.select("term").distinct()), "term", "left_semi").select("row_id", "term").distinct()
    tried = begun.join(sized(seeds), "term").select("row_id", "item_key").distinct()
    held = postings.join(sized(terms.select("term").distinct()), "term", "left_semi").select("row_id", "term").distinct()
    enough = tried.join(sized(terms), "item_key").join(held, ["row_id", "term"]).groupBy("row_id", "item_key").agg(F.count("*").alias("n_held"))
    both = enough.join(sized(sizes.select("item_key", "item_id", "n", "least")), "item_key").where(F.col("n_held") >= F.col("least"))
    both = materialize(both.select("row_id", "item_key", "item_id", "least", (F.col("n") + slop).alias("reach")), "rows")
    near = postings.join(sized(both.select("row_id").distinct()), "row_id", "left_semi")
    placed = both.join(sized(marked), "item_key").join(near, ["row_id", "term"]).withColumn("band", F.expr("pos div reach"))
    placed = materialize(placed.select("row_id", "item_key", "item_id", "least", "reach", "term", "rare", "pos", "band"), "places")
    around = placed.where("rare").select("row_id", "item_key", F.col("pos").alias("at"), F.explode(F.expr("sequence(band - 1, band + 1)")).alias("band"))
    return (
        placed.join(around, ["row_id", "item_key", "band"])
        .where(F.abs(F.col("pos") - F.col("at")) < F.col("reach"))
        .groupBy("row_id", "item_key", "item_id", "least", "at")
        .agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count_distinct("term").alias("n_terms"))
        .where(F.col("n_terms") >= F.col("least"))
        .select("row_id", "item_id", "first_pos", "last_pos", "n_terms")
        .distinct()
    )


def proximity_of(index: DataFrame, matches: DataFrame) -> DataFrame:
    """(row_id, n_near_items, near_items_sha256) of rows with near items; a null item id is not counted."""
    ids = matches.groupBy("row_id").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    return ids.select("row_id", F.size("ids").cast("long").alias("n_near_items"), F.sha2(F.concat_ws(",", "ids"), 256).alias("near_items_sha256"))


def scan(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", window: int = WINDOW_WORDS, slop: int = SLOP, share: float = SHARE) -> DataFrame:
    """The columns of ``contamination``, and n_near_items and near_items_sha256 by ``proximity_matches``, from one index.

    Rows, nulls, repeats and empty tables are treated as by ``contamination``; a null item
    id is not counted among near items either.
    """
    tokens = item_tokens(items, item_col=item_col, text_col=text_col)
    index = build_index(docs, id_col=id_col, text_col=text_col)
    own, tokens = own_postings(index, tokens)
    exact = contamination_of(index, phrase_matches(own, tokens, window=window), id_col="doc_id", keep=["row_id"])
    near = proximity_of(index, proximity_matches(own, tokens, slop=slop, share=share))
    out = exact.join(near, "row_id", "left").drop("row_id").withColumnRenamed("doc_id", id_col)
    return out.withColumns({"n_near_items": F.coalesce("n_near_items", F.lit(0)), "near_items_sha256": F.coalesce("near_items_sha256", F.sha2(F.lit("").cast("binary"), 256))})


def contamination(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    item_col: str = "item_id",
    text_col: str = "text",
    window: int = WINDOW_WORDS,
) -> DataFrame:
    """The share of each document's words inside test-item windows that it repeats.

    Returns the id, n_words, n_hit, n_items, items_sha256 and contaminated (n_hit > 0 and
    n_hit at least a twentieth of n_words), one row for each row of ``docs``. Null and
    empty texts have no words and are clean. Items without words never match; a null item
    id counts for hits and not for n_items. Repeated rows are told apart and each judged;
    repeated items count once. Without items every document is clean; without documents
    the result is empty. Other columns are not read. No text goes through a shuffle.
    """
    tokens = item_tokens(items, item_col=item_col, text_col=text_col)
    index = build_index(docs, id_col=id_col, text_col=text_col)
    own, tokens = own_postings(index, tokens)
    return contamination_of(index, phrase_matches(own, tokens, window=window), id_col=id_col)


def contamination_of(index: DataFrame, matches: DataFrame, *, id_col: str = "doc_id", keep: Sequence[str] = ()) -> DataFrame:
    matches = materialize(matches, "matches")
    words = matches.select("row_id", F.explode(F.expr("sequence(first_pos, first_pos + n - 1)")).alias("pos")).distinct()
    hits = words.groupBy("row_id").agg(F.count("*").alias("n_hit"))
    ids = matches.groupBy("row_id").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    n_hit, ids_or_none = F.coalesce("n_hit", F.lit(0)), F.coalesce("ids", F.array().cast("array<string>"))
    return (
        index.where("term IS NULL")
        .select("row_id", "doc_id", F.col("pos").cast("long").alias("n_words"))
        .join(hits.join(ids, "row_id"), "row_id", "left")
        .select(
            *keep,
            F.col("doc_id").alias(id_col),
            "n_words",
            n_hit.alias("n_hit"),
            F.size(ids_or_none).cast("long").alias("n_items"),
            F.sha2(F.concat_ws(",", ids_or_none), 256).alias("items_sha256"),
            ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        )
    )


def keep_clean(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, each judged by its own text.

    Null and repeated ids do no harm; null and empty texts stay. All columns stay, whatever
    their names; without items every row stays, and an empty table gives an empty result.
    """
    # Equal texts share a verdict, so that 128 bits of hash of the text name it and no row needs a number.
    key, text = free_name(docs, "text_key"), F.col(text_col)
    digest = F.struct(F.xxhash64(text), F.xxhash64(F.lit(1), text))
    found = contamination(docs.select(digest.alias(key), text.alias("text")), items, id_col=key).where("contaminated").select(key).distinct()
    return docs.withColumn(key, digest).join(sized(materialize(found, "contaminated")), key, "left_anti").select(docs.columns)


WORDS_SQL = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL} AS w FROM documents),
b AS (SELECT row_number() OVER () AS item, item_id, {WORDS_SQL} AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
win AS (
  SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS g
  FROM (SELECT item_id, w, least({WINDOW_WORDS}, len(w)) AS k, unnest(range(1, greatest(len(w) - {WINDOW_WORDS} + 1, 1) + 1)) AS s FROM b WHERE len(w) > 0)
),
placed AS (SELECT r, k, s, array_to_string(w[s:s + k - 1], ' ') AS g FROM (
  SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
m AS (SELECT r, s, win.k, item_id FROM placed JOIN win ON placed.g = win.g AND placed.k = win.k),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS p FROM m) GROUP BY r),
ids AS (SELECT r, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM m GROUP BY r),
post AS (SELECT r, unnest(w) AS term, unnest(range(len(w))) AS pos FROM d),
bt AS (SELECT DISTINCT item, len(w) + {SLOP} AS reach, len(list_distinct(w)) AS wanted, unnest(w) AS term FROM b),
f AS (SELECT term, count(*) AS freq FROM post GROUP BY term),
ranked AS (SELECT item, reach, term, ceil({SHARE} * wanted) AS least, row_number() OVER (PARTITION BY item ORDER BY coalesce(freq, 0), term) <= wanted - ceil({SHARE} * wanted) + 1 AS rare
  FROM bt LEFT JOIN f USING (term)),
held AS (SELECT r, item FROM (SELECT DISTINCT r, term FROM post) JOIN ranked USING (term) GROUP BY r, item, least HAVING count(*) >= least),
spots AS (SELECT r, item, reach, least, rare, term, pos FROM post JOIN ranked USING (term) SEMI JOIN held USING (r, item)),
close AS (SELECT DISTINCT r, item FROM (SELECT a.r, a.item FROM spots a JOIN spots z ON a.r = z.r AND a.item = z.item AND abs(a.pos - z.pos) < a.reach
  WHERE a.rare GROUP BY a.r, a.item, a.pos, a.least HAVING count(DISTINCT z.term) >= a.least)),
nears AS (SELECT r, count(DISTINCT item_id) AS n_near, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS near FROM close JOIN b USING (item) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
  coalesce(n_near, 0)::BIGINT AS n_near_items, sha256(coalesce(near, '')) AS near_items_sha256
FROM d LEFT JOIN hit USING (r) LEFT JOIN ids USING (r) LEFT JOIN nears USING (r)
"""
