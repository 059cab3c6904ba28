"""License scans by diagonal voting of word k-grams against notice templates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.text import words_column
from quillspan.session import materialize

# Phrases that name a license, and the label of each.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Words of public license notices, and the label of each.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("released under the mit license", "mit"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nd 4 0", "cc-by-nd"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by nc sa 4 0", "cc-by-nc-sa"),
    ("licensed under cc by nc nd 4 0", "cc-by-nc-nd"),
    ("creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "mit",
    ),
    (
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied",
        "apache",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by "
        "the free software foundation either version 3 of the license or at your option any later version",
        "gpl",
    ),
    (
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission",
        "bsd",
    ),
    (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from "
        "the use of this software",
        "zlib",
    ),
)
K = 2
#: Share of a notice's k-grams that makes a match.
SHARE = 0.8
#: Words that may be added or left out between the two parts of a match.
GAP = 2


def telling(words: list[str], others: list[list[str]]) -> list[int]:
    """Places of the k-grams that tell a notice from others.

    Where another notice has the same two words with something else between them (or
    nothing, and at most ``GAP`` words), and a third word in common beside them, all
    k-grams from the one to the other are needed: "by nc 4" isn't "by 4".
    """
    found: set[int] = set()
    for other in others:
        for p, q in ((p, q) for p in range(len(words)) for q in range(p + 1, min(p + GAP + 2, len(words)))):
            for i, j in ((i, j) for i in range(len(other)) for j in range(i + 1, min(i + GAP + 2, len(other)))):
                same = words[p] == other[i] and words[q] == other[j] and words[p + 1 : q] != other[i + 1 : j]
                if same and (p and i and words[p - 1] == other[i - 1] or words[q + 1 : q + 2] == other[j + 1 : j + 2] != []):
                    found.update(range(p, q))
    return sorted(found)


def templates(phrases=PHRASES, notices=NOTICES) -> list[tuple[int, str, bool, list[str], list[int]]]:
    """(template, label, base, its k-grams, places of those that no match may lack)."""
    rows = []
    cut = [(text.split(), label) for text, label in (*phrases, *notices)]
    for number, (words, label) in enumerate(cut):
        base = number < len(phrases)
        needed = range(len(words) - K + 1) if base else telling(words, [w for w, other in cut[len(phrases) :] if other != label])
        rows.append((number, label, base, [" ".join(words[i : i + K]) for i in range(len(words) - K + 1)], list(needed)))
    return rows


def votes(docs: DataFrame, rows: list[tuple], *, id_col: str, text_col: str) -> DataFrame:
    """Each document's k-grams that equal one of a template, and for each document one row without.

    The templates are a fixed list (under 200 rows), so that they are broadcast.
    """
    words = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("doc_id"), words_column(F.col(text_col)).alias("words"))
    grams = F.zip_with("words", F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    # The last word begins no k-gram; its null, or for a text without words the one put in, is the document's own row.
    rolled = words.select(
        "row_id", "doc_id", F.size("words").cast("long").alias("n_words"),
        F.posexplode(F.when(F.size("words") > 0, grams).otherwise(F.array(F.lit(None).cast("string")))).alias("pos", "gram"),
    ).withColumn("hash", F.xxhash64("gram"))
    known = [(number, i, gram) for number, _, _, grams, _ in rows for i, gram in enumerate(grams)]
    places = docs.sparkSession.createDataFrame(known, "template int, place int, known string").withColumn("hash", F.xxhash64("known"))
    met = rolled.join(F.broadcast(places), (rolled["hash"] == places["hash"]) & (F.col("gram") == F.col("known")), "left")
    return met.where("gram IS NULL OR known IS NOT NULL").select("row_id", "doc_id", "n_words", "pos", "template", "place")


def split_match() -> Column:
    """(n, lo, hi) of the best way to begin a template on one diagonal and end it on another.

    Up to some place the k-grams count on the first diagonal, from there on the second, so
    that they stand in the template's order; all needed ones must be among them.
    """

    def at(c: Column) -> Column:
        one, two = F.filter("places", lambda x: x < c), F.filter("near.places", lambda x: x >= c)
        used = F.concat(one, two)
        first, second = F.transform(one, lambda x: x + F.col("diagonal")), F.transform(two, lambda x: x + F.col("near.diagonal"))
        whole = F.concat(first, second)
        in_order = F.coalesce(F.array_max(first) < F.array_min(second), F.lit(True))
        valid = in_order & (F.size(F.array_except("needed", used)) == 0) & (F.size(used) >= F.col("least"))
        # The largest counts; of equal ones that which begins, then ends, first.
        return F.when(valid, F.struct(F.size(used).alias("n"), (-F.array_min(whole)).alias("lo"), (-F.array_max(whole) - (K - 1)).alias("hi")))

    return F.array_max(F.transform(F.sequence(F.lit(0), F.col("n_grams")), at))


def matches(voted: DataFrame, rows: list[tuple]) -> DataFrame:
    """(row_id, label, base, first_word, share): verified spans.

    Votes are counted by diagonal (word place less template place). A phrase needs all its
    k-grams on one diagonal. A notice's words may stand on one diagonal, or begin on one
    and go on on another at most ``GAP`` words away; ``SHARE`` of its k-grams must stand in
    order, with all that tell it from others. Of notices with different labels that share a
    word those with the largest share count, and of those the longest.
    """
    info = [(number, label, base, len(grams), math.ceil(SHARE * len(grams) - 1e-9), needed) for number, label, base, grams, needed in rows]
    info = voted.sparkSession.createDataFrame(info, "template int, label string, base boolean, n_grams int, least int, needed array<int>")
    cells = voted.where("template IS NOT NULL").withColumn("diagonal", F.col("pos") - F.col("place"))
    lines = cells.groupBy("row_id", "template", "diagonal").agg(F.collect_set("place").alias("places")).join(F.broadcast(info), "template")
    exact = lines.where("base AND size(places) = n_grams").select("row_id", "label", "base", F.col("diagonal").alias("first_word"), F.lit(1.0).alias("share"))
    beside = Window.partitionBy("row_id", "template").orderBy("diagonal").rangeBetween(-GAP, GAP)
    pairs = lines.where("NOT base").withColumn("beside", F.collect_list(F.struct("diagonal", "places")).over(beside)).withColumn("near", F.explode("beside")).drop("beside")
    pairs = pairs.where("size(places) + size(near.places) >= least").withColumn("best", split_match()).where("best IS NOT NULL")
    found = pairs.select(
        "row_id", "label", "base", (-F.col("best.lo")).alias("lo"), (-F.col("best.hi")).alias("hi"),
        F.struct((F.col("best.n") / F.col("n_grams")).alias("share"), "n_grams").alias("rank"),
    ).distinct()
    word = Window.partitionBy("row_id", "pos")
    covered = found.withColumn("pos", F.explode(F.sequence("lo", "hi"))).withColumn("top", F.max("rank").over(word))
    covered = covered.withColumn("lost", (F.col("rank") < F.col("top")) & F.array_contains(F.collect_set(F.struct("rank", "label")).over(word), F.struct(F.col("top").alias("rank"), "label")).__invert__())
    kept = covered.groupBy("row_id", "label", "base", "lo", "hi", "rank").agg(F.max("lost").alias("lost")).where("NOT lost")
    return exact.unionByName(kept.select("row_id", "label", "base", F.col("lo").alias("first_word"), F.col("rank.share").alias("share")))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """License phrases and notices of every whole text.

    Returns the id, n_words, n_base (places of phrases), first_word and last_word (the
    smallest and the largest of these places, words from 0), base_labels, labels (with
    those of the notices; distinct, sorted, comma-joined) and score (the largest share of a
    template that matched). Null and empty texts, and texts of one word: no labels, score
    0, places null. Notices that tie over the same words all count. Repeated rows are told apart; an empty table gives an empty result;
    columns other than the id and the text are not read. A text is read once and never
    shuffled; only k-grams that equal a template's are.
    """
    rows = templates(phrases, notices)
    voted = materialize(votes(docs, rows, id_col=id_col, text_col=text_col), "votes")
    found = matches(voted, rows).groupBy("row_id").agg(
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("first_word"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("first_word"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("score"),
    )
    own = voted.where("template IS NULL").select("row_id", "doc_id", "n_words")
    empty = {"n_base": F.lit(0), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    return own.join(found, "row_id", "left").select(
        F.col("doc_id").alias(id_col), "n_words",
        *(F.coalesce(c, empty[c]).alias(c) if c in empty else F.col(c) for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "score")),
    )


def sql() -> str:
    """The same for DuckDB; where two words of a notice stand, its other words are compared one by one."""
    of_notices = ", ".join(
        f"({number}, '{label}', {base}, {[*(g.split()[0] for g in grams), grams[-1].split()[1]]}, {needed}::INT[], {math.ceil(SHARE * len(grams) - 1e-9)})"
        for number, label, base, grams, needed in templates()
    )
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    same = "({0} + i >= 0 AND w[{0} + i + 1] = t[i + 1] AND w[{0} + i + 2] = t[i + 2])"
    return f"""
WITH n(template, label, base, t, needed, least) AS (VALUES {of_notices}),
places AS (SELECT template, i, t[i + 1] AS x, t[i + 2] AS y FROM (SELECT template, t, unnest(range(len(t) - 1)) AS i FROM n)),
d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
g AS (SELECT r, s - 1 AS pos, w[s] AS x, w[s + 1] AS y FROM (SELECT r, w, unnest(range(1, len(w))) AS s FROM d)),
lines AS (SELECT r, template, pos - i AS d, count(*) AS votes FROM g JOIN places USING (x, y) GROUP BY ALL),
phrases AS (SELECT r, label, d AS lo FROM lines JOIN n USING (template) WHERE base AND votes = len(t) - 1),
pairs AS (SELECT r, label, w, t, needed, least, a.d AS d1, b.d AS d2, unnest(range(len(t))) AS c FROM lines a JOIN lines b USING (r, template) JOIN n USING (template) JOIN d USING (r)
  WHERE NOT base AND abs(a.d - b.d) <= {GAP} AND a.votes + b.votes >= least),
checked AS (SELECT r, label, d1, d2, len(t) - 1 AS n_grams, needed, least, t, [i FOR i IN range(len(t) - 1) IF i < c AND {same.format("d1")}] AS u1, [i FOR i IN range(len(t) - 1) IF i >= c AND {same.format("d2")}] AS u2 FROM pairs),
valid AS (SELECT r, label, t, d1, d2, n_grams, len(u1) + len(u2) AS k, least(d1 + list_min(u1), d2 + list_min(u2)) AS lo, greatest(d1 + list_max(u1), d2 + list_max(u2)) + 1 AS hi
  FROM checked WHERE len(u1) + len(u2) >= least AND list_has_all(list_concat(u1, u2), needed) AND coalesce(d1 + list_max(u1) < d2 + list_min(u2), true)),
best AS (SELECT * FROM valid QUALIFY row_number() OVER (PARTITION BY r, label, t, d1, d2 ORDER BY k DESC, lo, hi) = 1),
m AS (SELECT DISTINCT r, label, lo, hi, k / n_grams AS share, n_grams FROM best),
spots AS (SELECT *, unnest(range(lo, hi + 1)) AS pos FROM m),
tops AS (SELECT r, pos, max({{'share': share, 'n_grams': n_grams}}) AS top FROM spots GROUP BY r, pos),
lost AS (SELECT DISTINCT r, s.label, lo, hi, share, n_grams FROM spots s JOIN tops USING (r, pos) WHERE {{'share': share, 'n_grams': n_grams}} < top
  AND NOT EXISTS (FROM spots o WHERE o.r = s.r AND o.pos = s.pos AND o.label = s.label AND {{'share': o.share, 'n_grams': o.n_grams}} = top)),
found AS (SELECT r, label, true AS base, lo, 1.0::DOUBLE AS share FROM phrases UNION ALL
  SELECT r, label, false, lo, share FROM m ANTI JOIN lost USING (r, label, lo, hi, share, n_grams)),
f AS (SELECT r, count(*) FILTER (base) AS n_base, min(lo) FILTER (base) AS first_word, max(lo) FILTER (base) AS last_word,
  array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(share) AS score FROM found GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN f USING (r)
"""
