"""License scans by diagonal voting, in DataFrame functions only.

Every rolling hash of two words is joined to the template positions with that hash. Each
match votes for the diagonal (its place in the text less its place in the template); votes
are counted by diagonal, neighbouring diagonals are merged, and a span counts by the share
of the template's word pairs it holds. Words are compared in the join, so hash collisions
do not vote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values: (label, phrase) whose exact places count.
BASE = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))

#: Fixed values: (label, wording) that may be found with small changes.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license"),
)

#: Share of a template's word pairs that its merged diagonals must hold.
SHARE = 0.8
#: Diagonals this far apart are one span: so many words put in or left out.
NEIGHBOURS = 2

_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.

    ``lower`` changes other letters too, but no template has them; the two signs whose lower
    case holds an ASCII letter are left to ``translate``.
    """
    odd = text.contains("İ") | text.contains("K")
    low = F.when(odd, F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))
    return F.array_remove(F.split(low, _BREAK), "")


def template_positions(spark, base=BASE, templates=TEMPLATES) -> DataFrame:
    """(label, exact, template, pairs, place, a, b): each word pair of each phrase. As many rows as the phrases have words."""
    rows = []
    for exact, phrases in ((True, base), (False, templates)):
        for label, phrase in phrases:
            ws = phrase.split(" ")
            rows += [(label, exact, len(rows), len(ws) - 1, i, a, b) for i, (a, b) in enumerate(zip(ws, ws[1:], strict=False))]
            first = len(rows) - (len(ws) - 1)
            rows[first:] = [(label, exact, first, *r[3:]) for r in rows[first:]]
    return spark.createDataFrame(rows, "label string, exact boolean, template int, pairs int, place int, a string, b string")


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", base=BASE, templates=TEMPLATES, share: float = SHARE, neighbours: int = NEIGHBOURS) -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``base`` phrases count where their words stand consecutively; ``templates`` where merged
    diagonals hold ``share`` of their word pairs. labels has both. score: the largest share
    that any phrase or template reaches, 0 if none. Null text is empty: no words, score 0. Rows are judged by
    (id, text), so repeated rows get equal answers, null ids too; other columns are not read; an empty table
    gives an empty one. A row of word pairs holds two words, not its text; the words of one text are in memory at once.
    """
    shown = docs.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("th"), words_of(F.col(text_column)).alias("ws"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("ws") - 2), lambda i: F.concat(F.get("ws", i), F.lit(" "), F.get("ws", i + 1)))
    rolled = shown.where(F.size("ws") >= 2).select("id", "th", F.posexplode(pairs).alias("at", "pair")).withColumn("h", F.xxhash64("pair"))
    words = F.concat("a", F.lit(" "), "b")
    positions = template_positions(docs.sparkSession, base, templates).select("label", "exact", "template", "pairs", "place", words.alias("words"), F.xxhash64(words).alias("key"))
    same = (F.col("h") == F.col("key")) & (F.col("pair") == F.col("words"))
    votes = rolled.join(F.broadcast(positions), same).select("id", "th", "label", "exact", "template", "pairs", "place", (F.col("at") - F.col("place")).alias("diagonal")).distinct()
    diagonals = votes.groupBy("id", "th", "label", "exact", "template", "pairs", "diagonal").agg(F.collect_list("place").alias("places"))
    along = Window.partitionBy("id", "th", "template").orderBy("diagonal")
    apart = F.when(F.col("exact") | (F.col("diagonal") - F.lag("diagonal").over(along) > neighbours), 1).otherwise(0)
    spans = (
        diagonals.withColumn("apart", apart)
        .withColumn("span", F.sum("apart").over(along))
        .groupBy("id", "th", "label", "exact", "template", "pairs", "span")
        .agg(F.min("diagonal").alias("start"), (F.size(F.array_distinct(F.flatten(F.collect_list("places")))) / F.col("pairs")).alias("held"))
    )
    exact = F.col("exact") & (F.col("held") == 1)
    found = spans.groupBy("id", "th").agg(
        F.count_if(exact).alias("n_base"),
        F.min(F.when(exact, F.col("start"))).alias("first_word"),
        F.max(F.when(exact, F.col("start"))).alias("last_word"),
        F.collect_set(F.when(exact, F.col("label"))).alias("base_labels"),
        F.collect_set(F.when(exact | (~F.col("exact") & (F.col("held") >= share)), F.col("label"))).alias("labels"),
        F.max("held").alias("score"),
    )
    shared = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit(""))
    return (
        shown.select("id", "th", F.coalesce(F.greatest(F.size("ws"), F.lit(0)), F.lit(0)).cast("long").alias("n_words"))
        .alias("d")
        .join(found.alias("f"), F.expr("d.id <=> f.id and d.th = f.th"), "left")
        .select(
            F.col("d.id").alias(id_column), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"),
            F.col("last_word").cast("long").alias("last_word"), shared("base_labels").alias("base_labels"), shared("labels").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
        )
    )
