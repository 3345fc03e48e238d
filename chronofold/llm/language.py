"""Operator 9: language identification by Bayesian evidence fusion.

The posterior of a document's language joins four kinds of evidence: the likelihood of its text under hashed byte-trigram
models, the language that its page's markup declares, the suffix of its page's address, and a prior of its host. Host
priors are counts of the text's own verdicts, smoothed towards the host's domain and that towards the whole corpus; how
far declarations and suffixes can be believed is counted against the text's verdicts too. All counts are grouped
aggregations over all rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.llm.common import saved

#: ASCII but letters ends a gram; A-Z are folded before.
LETTERS = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
BITS = 14


def gram_buckets(text: str) -> np.ndarray:
    """Bucket numbers of the byte trigrams of a text's letters; grams around a gap between words count, those of gaps do not."""
    b = np.frombuffer((" " + text.lower() + " ").encode().translate(LETTERS), dtype=np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, dtype=np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    code = code[(b[1:-1] != 0x20) | ((b[:-2] != 0x20) & (b[2:] != 0x20))]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)


#: Labelled rows from which on a language has a model: fixed, so that no language's model depends on the corpus's size.
LEAST_ROWS = 5


def declared_languages(docs: DataFrame, least_rows: int = LEAST_ROWS) -> list[str]:
    """All languages that label at least so many rows with an id and a text."""
    counts = docs.filter("lang is not null and text is not null and doc_id is not null").groupBy("lang").count()
    return sorted(r["lang"] for r in counts.filter(F.col("count") >= least_rows).select("lang").collect())


def mean_logs(model: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Per language the mean log probability of a text's grams; a long text's grams are counted first, which bounds the room."""
    if len(grams) <= 1 << BITS:
        return model[grams].mean(axis=0, dtype=np.float64)
    return np.bincount(grams, minlength=1 << BITS) @ model / len(grams)


def text_models(docs: DataFrame, languages: list[str]) -> np.ndarray:
    """Log probabilities (bucket, language), counted over all rows that are labelled with one of these languages."""
    place = {code: i for i, code in enumerate(languages)}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for code, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if place[code] not in total:
                    total[place[code]] = np.zeros(1 << BITS, dtype=np.int64)
                total[place[code]] += np.bincount(gram_buckets(text.as_py()), minlength=1 << BITS)
        for i, n in total.items():
            k = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), i)), pa.array(k), pa.array(n[k])], names=["language", "bucket", "n"])

    labelled = docs.filter(F.col("lang").isin(languages) & F.col("text").isNotNull()).select("lang", "text")
    grouped = labelled.mapInArrow(counted, "language long, bucket long, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros((1 << BITS, len(languages)))
    found = grouped.toArrow()  # buckets x languages at most
    counts[found["bucket"].to_numpy(), found["language"].to_numpy()] = found["n"].to_numpy()
    return np.log((counts + 0.1) / (counts.sum(axis=0) + 0.1 * len(counts))).astype(np.float32)


def least_mean(evidence: DataFrame, languages: list[str]) -> float:
    """The least mean log likelihood that a text of these languages has, from evidence(label, grams, mean).

    It is 1.5 below what all but a twentieth of the labelled texts of 200 grams and more reach, whatever odd texts are
    among them: all of them are counted by steps of a thousandth, so that the result does not depend on their order.
    """
    means = evidence.filter(F.col("label").isin(languages) & (F.col("grams") >= 200))
    steps = sorted(means.groupBy(F.floor(F.col("mean") * 1000).alias("step")).count().collect())  # some ten thousand at most
    total, below = sum(r["count"] for r in steps), 0
    for r in steps:
        below += r["count"]
        if 20 * below >= total:
            return r["step"] / 1000 - 1.5
    return -np.inf


def text_evidence(docs: DataFrame, languages: list[str], model: np.ndarray, most_grams: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns `carry`, grams, mean (log likelihood of the best language per gram) and likelihood (per language, tempered).

    A long text's grams are not independent, so that no text counts for more than `most_grams` of them.
    """
    schema = pa.schema([("row", pa.int64()), ("grams", pa.int64()), ("mean", pa.float64()), ("likelihood", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, best, all_of = [], [], []
            for text in b.column(1):
                grams = gram_buckets(text.as_py() or "")
                sums = mean_logs(model, grams) if len(grams) else np.zeros(len(languages))
                n.append(len(grams))
                best.append(float(sums.max()) if len(grams) else None)
                all_of.append(((sums - sums.max()) * min(len(grams), most_grams)).tolist() if len(sums) else [])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, type=pa.int64()), pa.array(best, type=pa.float64()), pa.array(all_of, type=schema.field(3).type), *b.columns[2:]],
                names=["doc_id", "grams", "mean", "likelihood", *b.schema.names[2:]],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source"), F.col("lang").alias("label"), *carry)
    carried = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    return rows.mapInArrow(run, f"doc_id long, grams long, mean double, likelihood array<double>, source string, label string{carried}")


def page_evidence(pages: DataFrame) -> DataFrame:
    """One row per document number in a page's address: host, domain, suffix and declared markup language.

    Of several pages of one document the one of the smallest page_id counts. Pages without such an address give nothing.
    """
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/:?#]+)", 1))
    number = F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]+/(?:[^?#]*/)?(\d{1,18})(?:\.html?)?/?(?:[?#].*)?$", 1)
    declared = F.lower(F.regexp_extract("html", r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1))
    rows = pages.select(F.col("page_id").alias("page"), host.alias("host"), number.alias("number"), declared.alias("declared")).filter("number != ''")
    rows = rows.select(
        F.col("number").cast("long").alias("page_doc"), "page", "host", F.element_at(F.split("host", r"\."), -1).alias("suffix"),
        F.regexp_extract("host", r"([^.]+\.[^.]+\.[^.]+|[^.]+\.[^.]+|[^.]+)$", 1).alias("domain"), F.expr("nullif(declared, '')").alias("declared"),
    )
    first = F.min_by(F.struct("host", "domain", "suffix", "declared"), F.struct("page", "host", "declared"))
    return rows.groupBy("page_doc").agg(first.alias("p")).select("page_doc", "p.*")


def shares(rows: DataFrame, key: list[str], languages: list[str], above: Column, weight: float) -> DataFrame:
    """Per key the smoothed share of each language: its own counts and `weight` of the level above."""
    counts = [F.sum((F.col("verdict") == i).cast("long")) for i in range(len(languages))]
    return rows.groupBy(*key).agg(F.array(*counts).alias("n"), F.first(above).alias("above")).select(
        *key, F.expr(f"transform(n, (x, i) -> (x + {weight} * above[i]) / (aggregate(n, 0D, (s, y) -> s + y) + {weight}))").alias("share")
    )


def fused(evidence: DataFrame, languages: list[str], weight: float = 20.0) -> DataFrame:
    """Adds posterior (per language) to evidence(grams, likelihood, host, domain, suffix, declared, unmodelled).

    Rows of a language without a model have no verdict and count towards no other language.
    """
    n = len(languages)
    uniform = F.array(*[F.lit(1.0 / n)] * n)
    best = F.expr("cast(array_position(likelihood, array_max(likelihood)) - 1 as int)")
    rows = evidence.withColumn("verdict", F.when((F.col("grams") > 0) & ~F.col("unmodelled"), best))
    judged = rows.filter("verdict is not null")
    top = judged.agg(*[F.sum((F.col("verdict") == i).cast("long")) for i in range(n)]).first()
    total = sum(x or 0 for x in top)
    corpus = F.array(*[F.lit(((x or 0) + 1.0) / (total + n)) for x in top])
    with_host = judged.filter("host is not null")
    domains = shares(with_host, ["domain"], languages, corpus, weight).withColumnRenamed("share", "domain_share")
    # Counts per host first; only then the few rows per host meet their domain.
    sums = [F.sum((F.col("verdict") == i).cast("long")) for i in range(n)]
    hosts = with_host.groupBy("host", "domain").agg(F.array(*sums).alias("n")).join(domains, "domain")
    hosts = hosts.select("host", F.expr(f"transform(n, (x, i) -> (x + {weight} * domain_share[i]) / (aggregate(n, 0D, (s, y) -> s + y) + {weight}))").alias("prior"))
    rows = rows.join(hosts, "host", "left").withColumn("prior", F.coalesce("prior", corpus))
    for clue in ("declared", "suffix"):
        # P(clue | language), from all rows that have the clue; smoothed towards the clue's overall share.
        seen = judged.filter(F.col(clue).isNotNull()).groupBy(clue).agg(F.array(*sums).alias("n"))
        each = seen.agg(*[F.sum(F.col("n")[i]) for i in range(n)]).first()
        sizes = F.array(*[F.lit(float(x or 0)) for x in each])
        all_of = float(sum(x or 0 for x in each)) or 1.0
        seen = seen.withColumn("sizes", sizes).select(
            clue,
            F.expr(
                f"transform(n, (x, i) -> ln((x + {weight} * aggregate(n, 0D, (s, y) -> s + y) / {all_of}) / (sizes[i] + {weight})))"
            ).alias(f"{clue}_log"),
        )
        rows = rows.join(seen, clue, "left").withColumn(f"{clue}_log", F.coalesce(f"{clue}_log", F.transform(uniform, lambda _: F.lit(0.0))))
    rows = rows.withColumn("logs", F.expr("transform(likelihood, (x, i) -> x + ln(prior[i]) + declared_log[i] + suffix_log[i])"))
    rows = rows.withColumn("weights", F.expr("transform(logs, x -> exp(x - array_max(logs)))"))
    return rows.withColumn("posterior", F.expr("transform(weights, x -> x / aggregate(weights, 0D, (s, y) -> s + y))"))


def identify(
    docs: DataFrame, pages: DataFrame | None = None, most_grams: int = 300, least_grams: int = 1, least_posterior: float = 0.5,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Judges every row of docs(doc_id, text, lang, source); pages(page_id, url, html) may bear on a document.

    Returns doc_id, host, declared, suffix, text_lang (by text alone), lang (by all evidence), posterior and kept. Only
    texts are rejected that no language explains: fewer than `least_grams` grams, a mean likelihood (of 50 grams or more)
    far under nearly all labelled texts' (see least_mean), or a posterior under the bound. Null and empty texts have no grams: their evidence is the
    rest, and they are rejected. Ties go to the language that sorts first. A document without a page has its source as
    host and no declaration or suffix. Repeated rows are judged each. Without labelled rows nothing can be judged: all
    languages are null and all rows with text are kept. lang is used to fit the models, not as evidence.

    Every language that labels LEAST_ROWS rows has a model, however large the corpus is. Rows labelled with a rarer one
    only lack a model: they keep their label as lang, have no text_lang and no posterior, and are kept if they have grams.
    So does a row without a label that no model explains, if its page declares a language without a model. The columns
    `carry` of docs pass as they are.
    """
    docs = docs.select("doc_id", "text", "lang", "source", *carry)
    languages = declared_languages(docs)
    if not languages:
        blank = [F.lit(None).cast("string").alias(c) for c in ("host", "declared", "suffix", "text_lang")] + [F.col("lang")]
        kept = F.length(F.coalesce("text", F.lit(""))) > 0
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *blank, F.lit(None).cast("double").alias("posterior"), kept.alias("kept"), *carry)
    rows = text_evidence(docs, languages, text_models(docs, languages), most_grams, carry)
    if pages is not None:
        rows = rows.join(page_evidence(pages), F.col("doc_id") == F.col("page_doc"), "left").drop("page_doc")
    else:
        rows = rows.select("*", *[F.lit(None).cast("string").alias(c) for c in ("host", "domain", "suffix", "declared")])
    rows = rows.withColumn("domain", F.coalesce("domain", F.lit("source"))).withColumn("host", F.coalesce("host", "source", F.lit("")))
    rows = saved(rows.drop("source"))
    alien = (F.col("grams") >= 50) & (F.col("mean") < least_mean(rows, languages))
    undeclared = ~F.col("declared").isin(sorted({re.split("[-_]", x)[0].lower() for x in languages}))
    rows = rows.withColumn("claim", F.coalesce("label", F.when(alien & undeclared, F.col("declared"))))
    rows = rows.withColumn("unmodelled", F.coalesce(~F.col("claim").isin(languages), F.lit(False)))
    evidence = fused(rows.drop("label"), languages)
    name = F.array(*[F.lit(x) for x in languages])
    best = F.expr("cast(array_position(posterior, array_max(posterior)) as int)")
    top = F.when(~F.col("unmodelled"), F.array_max("posterior"))
    kept = (F.col("grams") >= least_grams) & (F.col("unmodelled") | ~alien & (top >= least_posterior))
    return evidence.select(
        "doc_id", "host", "declared", "suffix", F.when(F.col("verdict").isNotNull(), F.element_at(name, F.col("verdict") + 1)).alias("text_lang"),
        F.when(F.col("unmodelled"), F.col("claim")).otherwise(F.element_at(name, best)).alias("lang"), top.alias("posterior"),
        F.coalesce(kept, F.lit(False)).alias("kept"), *carry,
    )
