"""Quotes found in any text: an index of fixed-length pieces proposes texts for each quote, exact comparison decides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.decisions import quote_head, quote_verdict
from marlstone.sources.shared import written

#: Letters of the pieces into which texts are cut; any run of 2 * PIECE - 1 letters holds a whole piece.
PIECE = 12
#: Quotes of so many letters or more are also looked for without their digits.
LEAST_BARE = 40


def _holders(quotes: DataFrame, texts: DataFrame, piece: int) -> DataFrame:
    """(quote, text): texts that may hold the strings quotes(quote, q), each of 2 * piece - 1 letters or more, among texts(text, t).

    A text is cut into pieces one after another. Where a text holds a string, a piece of it lies within the string at one of `piece` offsets from the string's begin. So for each such offset one of the string's pieces there is
    looked up, the one that the fewest texts have: a string costs `piece` lookups of rare pieces, however often its other pieces occur.
    """
    every = F.sequence(F.lit(0), F.length("q") - piece)
    grams = F.transform(every, lambda i: F.struct(i.alias("i"), F.xxhash64(F.substring("q", i + 1, F.lit(piece))).alias("h")))
    grams = written(quotes.select("quote", F.explode(grams).alias("g")).select("quote", F.pmod(F.col("g.i"), F.lit(piece)).alias("offset"), "g.h"), "quote-pieces")
    # one pass over the text: a substring would be counted off from its begin for every piece
    blocks = F.regexp_extract_all("t", F.lit(f"(?s).{{{piece}}}"), F.lit(0))
    pieces = texts.select("text", F.explode(blocks).alias("g")).select("text", F.xxhash64("g").alias("h")).join(grams.select("h").distinct(), "h", "left_semi").distinct()
    pieces = written(pieces, "text-pieces")
    counts = pieces.groupBy("h").agg(F.count("*").alias("n"))
    # a piece that no text has rules its offset out
    rated = grams.join(counts, "h", "left").groupBy("quote", "offset").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h")).alias("best"))
    return rated.where("best.n > 0").select("quote", F.col("best.h").alias("h")).join(pieces, "h").select("quote", "text").distinct()


def verified(quotes: DataFrame, texts: DataFrame, quote_key: str, quote: Column, text_key: str, text: Column) -> DataFrame:
    """(quote_key, text_key, verdict) for every quote that a text holds: `whole`, `prefix` or `digits`, see decisions.quote_verdict.

    quote and text are reduced to letters and digits. Keys are unique; null and empty quotes and texts hold nothing. Quotes meet only texts that share a rare piece with them, and every
    text that holds one does. Quotes shorter than 2 * PIECE - 1 letters go by shorter pieces, of half their length: one pass over the texts for each such length that occurs.
    """
    q = written(quotes.select(F.col(quote_key).alias("quote"), quote.alias("q")).where("q <> ''"), "quotes")
    t = written(texts.select(F.col(text_key).alias("text"), text.alias("t")).where("t <> ''"), "texts")
    bare = lambda c: F.regexp_replace(c, r"\d+", "")
    heads = q.select("quote", quote_head(F.col("q")).alias("q"))
    plain = q.where(F.length("q") >= LEAST_BARE).select("quote", bare("q").alias("q")).where("q <> ''")
    found = []
    for wanted, among in ((heads, t), (plain, t.select("text", bare("t").alias("t")))):
        sized = wanted.withColumn("piece", F.least(F.lit(PIECE), F.floor((F.length("q") + 1) / 2).cast("int")))
        for r in sized.select("piece").distinct().collect():  # at most PIECE rows
            found.append(_holders(sized.where(F.col("piece") == r["piece"]), among, r["piece"]))
    if not found:
        return q.join(t, F.lit(False)).select(F.col("quote").alias(quote_key), F.col("text").alias(text_key), F.lit("").alias("verdict"))
    pairs = reduce(DataFrame.unionByName, found).distinct()
    judged = pairs.join(q, "quote").join(t, "text").select(F.col("quote").alias(quote_key), F.col("text").alias(text_key), quote_verdict(F.col("q"), F.col("t"), least_bare=LEAST_BARE).alias("verdict"))
    return judged.where("verdict <> 'none'")
