"""Spelling variants: words that differ by one edit, each pointing to a far more frequent neighbour.

Asymmetric q-chunks. Of a pair the longer word (at equal length: each) contributes its two disjoint chunks, the halves; the other one its
positional grams, for the lengths its partner can have. One edit leaves a half unchanged, at a position shifted by the difference of the
lengths at most, so pairs meet at an equal chunk and are verified by edit distance. A chunk that many words share is opened by the same
step inside what it leaves free: the free half is halved again, until few words share a key or a single code point is free. So no
large group is ever joined with itself, and none is cut.

A pair can meet at several keys; it counts where the words' first difference puts it: at the key that keeps the left part if the words
agree there, else at the one that keeps the right part.

Cases: null texts have no words; a null id reads as empty text in the hash; repeated rows count each time; ties of the form go to
the smallest word in code-point order; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odflow.session import write_table

LEAST_LENGTH = 7
LEAST_COUNT = 2
LEAST_FACTOR = 10
#: A key shared by more words of the chunk side than this is opened.
MOST_SHARED = 32
#: One of so many occurrences loses a code point.
NOISE = 31


def noisy_words(docs: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """``word``, one row for each occurrence of at least ``least`` code points, after the seeded deletions."""
    letters = F.lit(f"[A-Za-zÀ-ÿ]{{{least},}}")
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), letters, F.lit(0))).alias("_run"))
    low = runs.select("_id", F.translate("_run", string.ascii_uppercase, string.ascii_lowercase).alias("_low"))
    hashed = low.select("_low", F.crc32(F.concat_ws(":", "_id", "_low").cast("binary")).alias("_h"))
    at = F.pmod("_h", F.length("_low")).cast("int")
    cut = F.concat(F.substring("_low", F.lit(1), at), F.substring("_low", at + 2, F.length("_low")))
    return hashed.select(F.when(F.pmod("_h", F.lit(NOISE)) == 0, cut).otherwise(F.col("_low")).alias("word")).where(F.length("word") >= least)


def counted(words: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _keyed(side: DataFrame) -> DataFrame:
    """Key of what stands left of ``lo`` and right of ``hi``, both counted in a chunk word of ``size`` code points."""
    left = F.substring("word", F.lit(1), F.col("lo"))
    right = F.substring("word", F.length("word") - (F.col("size") - F.col("hi")) + 1, F.col("size"))
    return side.withColumn("key", F.xxhash64("size", "lo", "hi", left, right))


def _halved(side: DataFrame) -> DataFrame:
    """Both keys of every row: the free part's right half stays free, or its left half."""
    middle = F.expr("lo + (hi - lo) div 2")
    whole = lambda c: c.cast("int")
    parts = F.array(F.struct(whole(middle).alias("lo"), whole(F.col("hi")).alias("hi")), F.struct(whole(F.col("lo")).alias("lo"), whole(middle).alias("hi")))
    return _keyed(side.withColumn("_part", F.explode(parts)).select("word", "n", "size", "_part.lo", "_part.hi"))


def _verified(chunks: DataFrame, grams: DataFrame) -> DataFrame:
    """Pairs at an equal key that are one edit apart and belong to this key."""
    a, b = chunks.alias("a"), grams.alias("b")
    prefix = lambda side, to: F.substring(F.col(f"{side}.word"), F.lit(1), to)
    met = (F.col("a.key") == F.col("b.key")) & (F.col("a.size") == F.col("b.size")) & (F.col("a.lo") == F.col("b.lo")) & (F.col("a.hi") == F.col("b.hi"))
    once = (F.length("a.word") > F.length("b.word")) | (F.col("a.word") < F.col("b.word"))
    here = (prefix("a", F.col("a.lo")) == prefix("b", F.col("a.lo"))) & ((F.col("a.hi") == F.col("a.size")) | (prefix("a", F.col("a.hi")) != prefix("b", F.col("a.hi"))))
    near = F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1
    return a.join(b, met & once & here & near).select(
        F.col("a.word").alias("word"), F.col("a.n").alias("n"), F.col("b.word").alias("other"), F.col("b.n").alias("other_n")
    )


def near_pairs(words: DataFrame, most_shared: int = MOST_SHARED) -> DataFrame:
    """``word, n, other, other_n``: every pair of words one edit apart, once.

    ``words`` holds distinct ``word`` and ``n``. Two words of one code point each have no two chunks and are no pair here.
    """
    whole = words.select("word", F.col("n").cast("long").alias("n"), F.length("word").alias("_l"))
    sized = lambda size: whole.withColumn("size", size).where("size > 1").select("word", "n", "size", F.lit(0).alias("lo"), F.col("size").alias("hi"))
    chunks = _halved(sized(F.col("_l")))
    grams = _halved(sized(F.explode(F.array(F.col("_l"), F.col("_l") + 1))))
    found = []
    while True:
        crowded = F.col("hi") - F.col("lo") > 1
        hot = write_table(chunks.where(crowded).groupBy("key").count().where(F.col("count") > most_shared).select("key"))
        found.append(_verified(chunks.join(hot, "key", "left_anti"), grams.join(hot, "key", "left_anti")))
        if hot.isEmpty():
            break
        chunks, grams = (write_table(_halved(side.join(hot, "key", "left_semi").where(crowded))) for side in (chunks, grams))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def forms(words: DataFrame, pairs: DataFrame, factor: int = LEAST_FACTOR) -> DataFrame:
    """``word, n, n_near, form, form_n`` of every word."""
    ends = F.explode(F.array(F.struct("word", F.col("other").alias("near"), F.col("other_n").alias("near_n")), F.struct(F.col("other").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
    best = pairs.select(ends.alias("_e")).groupBy("_e.word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("_e.near_n")).alias("less"), F.col("_e.near").alias("near"))).alias("_best"))
    likely = F.coalesce(-F.col("_best.less") >= F.col("n") * factor, F.lit(False))
    if_likely: Column = lambda c: F.when(likely, c)
    return words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), if_likely(F.col("_best.near")).alias("form"), if_likely(-F.col("_best.less")).alias("form_n")
    )


def roots(links: DataFrame) -> DataFrame:
    """``word, root``: where the forms of ``links`` (``word, form``) lead to. Every round doubles the steps taken."""
    up = write_table(links.select("word", F.col("form").alias("root")))
    while True:
        above = up.select(F.col("word").alias("root"), F.col("root").alias("_above"))
        up = write_table(up.select("word", "root").join(above, "root", "left").select("word", F.coalesce("_above", "root").alias("root"), F.col("_above").isNotNull().alias("moved")))
        if up.where("moved").isEmpty():
            return up.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``docs``."""
    words = write_table(counted(noisy_words(docs.select("doc_id", "text"))))
    found = write_table(forms(words, near_pairs(words)))
    lead = roots(found.where("form IS NOT NULL").select("word", "form"))
    return found.join(lead, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
