"""Language of pages by Bayesian fusion: text, declared markup language, address suffix and smoothed host priors.

The text likelihood is a naive Bayes model over character trigrams (hashed to a fixed table), fitted on a bounded
sample of labelled documents. Posteriors of all pages, from their text alone, are then summed by grouped
aggregation: per declared language (what a declaration is worth), and per host, its last three labels, last two
and last one. Each level of an address is smoothed towards the one above it, but for one that has no more pages
than the level below, and a page's own share is taken out of the sums before they judge it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmeter.llm.common import col, id_and_text
from rillmeter.llm.html_text import main_text
from rillmeter.session import materialise

#: Labelled documents used per language (those with the smallest hash of their doc_id), table size, most languages.
PER_LANGUAGE, BUCKETS, MOST_LANGUAGES = 1_500, 1 << 15, 200
#: Weight of a trigram against independence, pseudo-counts of the levels, and share of declarations taken for noise.
TEMPER, SMOOTHING = 0.2, 5.0
#: Levels of an address: its last label, last two, last three, and all of them.
LEVELS = ("suffix", "domain", "site", "host")
_HTML = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title)\b.*?(?:</\1|\Z)|<html\b([^>]*+)", re.I | re.S)
_LANG = re.compile(r"\blang\s*=\s*[\"']?([a-zA-Z]{2,3})", re.I)


def trigrams(text: str) -> np.ndarray:
    """Hashed character trigrams of the lower-cased words of a text, each word with a blank on either side."""
    words = " ".join(re.findall(r"[^\W\d_]+", text.lower()))
    if not words:
        return np.zeros(0, np.int64)
    points = np.frombuffer(f" {words} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    mixed = points[:-2] * np.uint64(0x9E3779B1) + points[1:-1] * np.uint64(0x85EBCA77) + points[2:] * np.uint64(0xC2B2AE3D)
    return ((mixed ^ (mixed >> np.uint64(15))) % np.uint64(BUCKETS)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch], languages: list[str]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((len(languages), BUCKETS), np.int64)
    for batch in batches:
        for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist()):
            total[languages.index(lang)] += np.bincount(trigrams(text), minlength=BUCKETS)
    lang, bucket = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(bucket), pa.array(total[lang, bucket])], names=["lang", "bucket", "n"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE,
        most_languages: int = MOST_LANGUAGES) -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and log probabilities of trigrams, languages by buckets.

    Raises ValueError if the labels name more than ``most_languages``: the table, sent to all tasks, grows with them.
    """
    labelled = docs.where(col(lang_col).isNotNull() & col(id_col).isNotNull())
    named = labelled.select(col(lang_col).cast("string").alias("lang")).distinct().limit(most_languages + 1)
    languages = sorted(r["lang"] for r in named.collect())
    if len(languages) > most_languages:
        raise ValueError(f"more than {most_languages} languages; raise most_languages")
    if not languages:
        return [], np.zeros((0, BUCKETS))
    keys = labelled.select(col(id_col).cast("long").alias("doc_id"), col(lang_col).cast("string").alias("lang")).distinct()
    some = None
    for lang in languages:
        part = keys.where(F.col("lang") == lang).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_language)
        some = part if some is None else some.union(part)
    sample = id_and_text(docs, id_col, text_col).join(F.broadcast(some), "doc_id")  # at most per_language rows a language
    counts = sample.repartition(8, "doc_id").mapInArrow(lambda b: _counted(b, languages), "lang long, bucket long, n long")
    rows = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most languages x BUCKETS rows
    table = np.full((len(languages), BUCKETS), 0.1)
    table[rows["lang"].to_numpy(), rows["bucket"].to_numpy()] += rows["n"].to_numpy()
    return languages, np.log(table / table.sum(1, keepdims=True))


def declared_language(page: str) -> str:
    """Language of the first <html> tag that names one, wherever it stands; "" without one. Comments and scripts hold no tags."""
    found = (_LANG.search(m[2]) for m in _HTML.finditer(page) if m[2])
    return next((m[1].lower() for m in found if m), "")


def _evidence(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    languages, table = shared.value
    for batch in batches:
        posterior, declared, grams = [], [], []
        for page in batch["html"].to_pylist():
            found = trigrams(main_text(page))
            score = TEMPER * table[:, found].sum(1)
            score = np.exp(score - score.max())
            posterior.append((score / score.sum()).tolist())
            declared.append(declared_language(page))
            grams.append(len(found))
        yield pa.RecordBatch.from_arrays(
            [*(batch[c] for c in ("page_id", "url", *LEVELS, "row_id")), pa.array(declared), pa.array(grams, pa.int64()), pa.array(posterior, pa.list_(pa.float64()))],
            names=["page_id", "url", *LEVELS, "row_id", "declared", "n_grams", "text_posterior"],
        )


def _plus(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a + b)


def _sums(pages: DataFrame, key: str, n: int) -> DataFrame:
    """Pages and summed text posteriors by a key; partial sums are made before the shuffle."""
    total = pages.groupBy(key).agg(F.count(F.lit(1)).cast("double").alias("m"), *[F.sum(F.col("text_posterior")[i]).alias(f"p{i}") for i in range(n)])
    return total.select(key, F.col("m").alias(f"{key}_m"), F.array(*[F.col(f"p{i}") for i in range(n)]).alias(f"{key}_sum"))


def detect(pages: DataFrame, docs: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """For every row of ``pages``: page_id, url, lang, confidence, text_lang, declared, n_grams.

    ``docs`` holds labelled texts (doc_id, text, lang). Null and empty pages have no text evidence; null addresses
    share one empty host. Declarations that are missing are a declaration of their own. Repeated rows are judged each on its own. Ties
    go to the first language in order. Without labelled texts lang is null and confidence 0.
    """
    spark = pages.sparkSession
    languages, table = fit(docs)
    host = F.lower(F.regexp_extract(F.coalesce(col(url_col).cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    rows = pages.select(
        col(id_col).cast("long").alias("page_id"), col(url_col).cast("string").alias("url"), F.coalesce(col(html_col).cast("string"), F.lit("")).alias("html"),
        host.alias("host"), F.monotonically_increasing_id().alias("row_id"),
    ).withColumns({level: F.substring_index("host", ".", -labels) for labels, level in enumerate(LEVELS[:-1], 1)})
    if not languages:
        return rows.select(
            "page_id", "url", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("text_lang"),
            F.lit("").alias("declared"), F.lit(0).cast("long").alias("n_grams"),
        )
    shared = spark.sparkContext.broadcast((languages, table))
    kind = "page_id long, url string, " + "".join(f"{level} string, " for level in LEVELS) + "row_id long, declared string, n_grams long, text_posterior array<double>"
    seen = materialise(rows.mapInArrow(lambda b: _evidence(b, shared), kind), "page-evidence")
    n = len(languages)
    own = F.col("text_posterior")
    whole = seen.agg(F.count(F.lit(1)), *[F.sum(own[i]) for i in range(n)]).first()
    total = max(1, whole[0])
    overall = F.array(*[F.lit((float(whole[1 + i] or 0) + 1) / (total + n)) for i in range(n)])
    joined = seen
    for key in (*LEVELS, "declared"):
        # Stored first: both sides come straight from a shuffle, so adaptive execution can split a hot host or suffix.
        joined = joined.join(materialise(_sums(seen, key, n), f"{key}-sums"), key)

    def smoothed(key: str, above: Column) -> Column:
        rest = F.zip_with(F.col(f"{key}_sum"), own, lambda s, p: F.greatest(s - p, F.lit(0.0)))
        return F.zip_with(rest, above, lambda s, a: (s + SMOOTHING * a) / (F.col(f"{key}_m") - 1 + SMOOTHING))

    judged = joined.withColumn("overall", overall)
    above = "overall"
    for level, below in zip(LEVELS, (*LEVELS[1:], None)):
        prior = smoothed(level, F.col(above))
        if below:  # a level with no pages but those of the one below would count them twice
            prior = F.when(F.col(f"{level}_m") == F.col(f"{below}_m"), F.col(above)).otherwise(prior)
        judged = judged.withColumn(f"{level}_prior", prior)
        above = f"{level}_prior"
    judged = judged.withColumn("said", F.zip_with(smoothed("declared", F.col("overall")), "overall", lambda d, a: d / a))
    log = lambda c: F.transform(c, lambda x: F.log(F.greatest(x, F.lit(1e-12))))
    judged = judged.withColumn("log_posterior", _plus(_plus(log("text_posterior"), log("host_prior")), log("said")))
    judged = judged.withColumn("odds", F.transform("log_posterior", lambda x: F.exp(x - F.array_max("log_posterior"))))
    names = F.array(*[F.lit(x) for x in languages])

    def first_best(c: str) -> Column:
        return F.element_at(names, F.array_position(F.col(c), F.array_max(c)).cast("int"))

    return judged.select(
        "page_id", "url", first_best("log_posterior").alias("lang"),
        (1 / F.aggregate("odds", F.lit(0.0), lambda a, x: a + x)).alias("confidence"),
        F.when(F.col("n_grams") > 0, first_best("text_posterior")).alias("text_lang"), "declared", "n_grams",
    )
