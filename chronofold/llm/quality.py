"""Operator 2: quality rules by a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Words and word pairs are hashed to a fixed number of buckets. Two multinomials over the buckets, one of trusted target
documents and one of the whole raw corpus, give each bucket a log ratio; a document's score is their mean over its
n-grams, and a document is kept exactly if the score reaches the threshold. Base rules on length and repetition come first.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands between words.
GAPS = r"[\x20\x09-\x0D]+"


def words_of(text: str = "text") -> Column:
    return F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), GAPS), "")


def neighbours(codes: str, step: int) -> Column:
    """A hash of each element of an array of hashes and the one `step` after it."""
    some = F.greatest(F.size(codes) - step, F.lit(0))
    return F.zip_with(F.slice(codes, F.lit(1), some), F.slice(codes, F.lit(step + 1), some), lambda a, b: F.xxhash64(a, b))


def coded(docs: DataFrame) -> DataFrame:
    """doc_id and text of docs with words, codes (their 64-bit hashes) and pairs (hashes of neighbouring codes).

    Each array is a column of a step of its own: later ones use it several times, and it is then made once.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", words_of().alias("words"))
    rows = rows.withColumn("codes", F.transform("words", lambda w: F.xxhash64(w)))
    return rows.withColumn("pairs", neighbours("codes", 1))


def windowed(rows: DataFrame, width: int) -> DataFrame:
    """rows of coded() with `hashes`, one for each window of `width` words: two windows that meet or overlap make a longer one."""
    rows, size = (rows.withColumn("hashes", F.col("codes")), 1) if width < 2 else (rows.withColumn("hashes", F.col("pairs")), 2)
    while size < width:
        step = min(size, width - size)
        rows, size = rows.withColumn("hashes", neighbours("hashes", step)), size + step
    return rows


def measured(docs: DataFrame, width: int = 8) -> DataFrame:
    """docs(doc_id, text) with words, codes, pairs, n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    n_repeat_words counts the words inside windows of `width` words that occur twice or more in the text. Windows are
    compared by 64-bit hashes. Only texts with a repeated hash are sorted: by (hash, place), then the places of repeated
    ones are put in order and each covers the words up to the next one's start.
    """
    rows = windowed(coded(docs), width)
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumn("lines", lines)
    again = F.expr(
        "if(size(array_distinct(hashes)) = size(hashes), null,"
        " array_sort(transform(hashes, (h, i) -> struct(h as h, i as i))))"
    )
    rows = rows.withColumn("sorted", again).drop("hashes")
    places = F.expr(
        "if(sorted is null, null, array_sort(transform(filter(sorted, (x, k) ->"
        " (k > 0 and sorted[k - 1].h = x.h) or (k < size(sorted) - 1 and sorted[k + 1].h = x.h)), x -> x.i)))"
    )
    rows = rows.withColumn("places", places).drop("sorted")
    covered = F.expr(
        f"if(places is null, 0L, aggregate(places, struct(0L as n, -1000000L as last),"
        f" (s, p) -> struct(s.n + least({width}L, cast(p as bigint) - s.last) as n, cast(p as bigint) as last), s -> s.n))"
    )
    return rows.select(
        "doc_id", "words", "codes", "pairs", F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    )


def trusted_ids(labels: DataFrame, most: int) -> DataFrame:
    """At most `most` doc_ids of quality 1, by a hash of the id: the trusted target."""
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).withColumn("trusted", F.lit(1))


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int, trusted_rows: int) -> list[float]:
    """log(target share / raw share) of each bucket; raw counts cover all of docs. One number per bucket reaches the driver."""
    rows = coded(docs).select("doc_id", "codes", "pairs").join(F.broadcast(trusted_ids(labels, trusted_rows)), "doc_id", "left")
    seen = rows.select(F.coalesce("trusted", F.lit(0)).alias("trusted"), F.explode(F.concat("codes", "pairs")).alias("gram"))
    counts = seen.groupBy(F.pmod("gram", F.lit(buckets)).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("raw"), F.sum("trusted").alias("target")).collect()
    raw, target = [0] * buckets, [0] * buckets
    for r in counts:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    all_raw, all_target = sum(raw) + buckets, sum(target)
    if not all_target:
        return [0.0] * buckets
    # The target's share is smoothed by a little of the raw one, so that a bucket unseen in the target stays finite.
    smooth = 0.02
    out = []
    for r, t in zip(raw, target, strict=True):
        share = (r + 1) / all_raw
        out.append(math.log(((1 - smooth) * t / all_target + smooth * share) / share))
    return out


def judge(docs: DataFrame, labels: DataFrame, buckets: int = 8192, trusted_rows: int = 20_000, threshold: float = -0.1, width: int = 8) -> DataFrame:
    """Applies the base rules and the log-likelihood ratio to every row of docs(doc_id, text).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr (mean log ratio per
    n-gram, 0 without any) and kept. A null text has no words and fails; so does an empty one. Repeated rows are judged
    each; ties at the threshold are kept. The trusted multinomial comes from at most `trusted_rows` documents of quality
    1; without any, every ratio is 0 and the base rules decide alone. Raw counts cover all rows.
    """
    ratios = log_ratios(docs, labels, buckets, trusted_rows)
    table = F.expr(f"from_json('{json.dumps([round(x, 9) for x in ratios])}', 'array<double>')")
    rows = measured(docs, width).withColumn("grams", F.concat("codes", "pairs")).withColumn("ratios", table)
    total = f"aggregate(grams, 0D, (s, g) -> s + ratios[cast(pmod(g, {buckets}) as int)])"
    rows = rows.withColumn("llr", F.expr(f"if(size(grams) = 0, 0D, {total} / size(grams))"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "llr",
        (~failed & (F.col("llr") >= threshold)).alias("kept"),
    )
