"""Language identification by Bayesian fusion of a page's text with its declared markup language, address suffix and host.

Text: a naive Bayes model over hashed byte trigrams, fitted on at most about ``TRAIN_ROWS`` labelled documents that a hash chooses;
the mean log-likelihood of a trigram counts ``TEMPER`` times for each one, and for ``MOST_GRAMS`` of them at most, since neighbouring trigrams of one
text are not independent evidence: beyond some hundred of them more text says nothing that a declared language should not be able to outweigh.
All trigrams of the whole text go into the mean. All languages of the labelled sample can be answered. Evidence: the soft counts of text posteriors, over **all**
pages, give the likelihood of each declared language and of each address suffix. Prior: soft counts by host, smoothed towards those of its
registered domain, those towards its suffix, those towards all pages; a page's own count is left out. All counts are grouped
aggregations; each host's row is joined back to its pages.

Edge cases: null or empty markup has no text evidence; a null address has the empty host; pages without any evidence get the overall prior;
repeated pages count each; a null ``page_id`` is kept; without labelled documents every page is ``und``; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import join_small, stored
from .words import slices, utf8

TRAIN_ROWS = 20_000
BUCKETS = 1 << 15
TEMPER = 0.25
MOST_GRAMS = 400
STRENGTH = {"host": 5.0, "domain": 10.0, "suffix": 20.0}


def page_text(html: Column) -> Column:
    """The visible text: scripts, styles, comments, navigation and tags go, a few entities are read."""
    text = F.coalesce(html, F.lit(""))
    text = F.regexp_replace(text, r"(?is)<(script|style|nav|head)\b.*?</\1\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*+>", " ")
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def _grams(text: bytes) -> np.ndarray:
    b = np.frombuffer(b" " + text.lower() + b" ", dtype=np.uint8).astype(np.uint64)
    if len(b) < 3:
        return np.zeros(0, dtype=np.int64)
    h = (b[:-2] << np.uint64(16) | b[1:-1] << np.uint64(8) | b[2:]) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - 15)).astype(np.int64)


def _count(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, place = np.zeros((len(names), BUCKETS), dtype=np.int64), {x: i for i, x in enumerate(names)}
        for batch in slices(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), utf8(batch.column("text"))):
                counts[place[lang]] += np.bincount(_grams(text), minlength=BUCKETS)
        lang, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(bucket), pa.array(counts[lang, bucket])], names=["lang", "bucket", "n"])

    return run


class TextModel:
    """Log-probabilities of trigram buckets by language; ``BUCKETS`` numbers for each language of the sample."""

    def __init__(self, docs: DataFrame, rows: int = TRAIN_ROWS) -> None:
        labelled = docs.where("lang is not null and text is not null")
        share = min(1.0, rows / max(1, labelled.count()))
        chosen = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1_000_000)) < share * 1_000_000)
        self.names = sorted(r["lang"] for r in chosen.select("lang").distinct().collect())  # of some ``rows`` labels
        counted = chosen.select("lang", "text").mapInArrow(_count(self.names), "lang long, bucket long, n long")
        table = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
        n = np.full((len(self.names), BUCKETS), 0.5)
        n[table.column("lang").to_numpy(), table.column("bucket").to_numpy()] += table.column("n").to_numpy()
        self.log = np.log(n / n.sum(axis=1, keepdims=True)).astype(np.float32)


def _likelihoods(log, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = log.value
        for batch in slices(batches):
            out = np.zeros((batch.num_rows, size))
            for i, text in enumerate(utf8(batch.column("text"))):
                if text.strip():
                    g = _grams(text.strip())
                    mean = table[:, g].mean(axis=1, dtype=np.float64)
                    out[i] = (mean - mean.max()) * min(len(g), MOST_GRAMS) * TEMPER
            scores = pa.array(out.tolist(), pa.list_(pa.float64()))
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), scores], names=[*kept, "loglik"])

    return run


def posterior(scores: Column) -> Column:
    """Probabilities from log-scores."""
    top = F.array_max(scores)
    raw = F.transform(scores, lambda x: F.exp(x - top))
    return F.transform(raw, lambda x: x / F.aggregate(raw, F.lit(0.0), lambda a, b: a + b))


def _sums(df: DataFrame, keys: list[str], size: int, prefix: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.array(*[F.sum(F.get("p", F.lit(i))) for i in range(size)]).alias(f"{prefix}_sum"), F.count("*").alias(f"{prefix}_n"))


def _evidence(df: DataFrame, by: str, size: int, all_sums: list[float]) -> DataFrame:
    """``(by, by_log)``: log P(value | language), smoothed over the values."""
    sums = stored(_sums(df, [by], size, by), f"lang-{by}-sums")
    values = max(1, sums.count())
    return stored(sums.select(by, F.array(*[F.log((F.get(f"{by}_sum", F.lit(i)) + 0.5) / (all_sums[i] + 0.5 * values)) for i in range(size)]).alias(f"{by}_log")), f"lang-{by}")


def _smoothed(counts: Column, above: Column, strength: Column, n: Column) -> Column:
    return F.zip_with(counts, above, lambda c, q: (c + strength * q) / (n + strength))


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """``page_id, host, declared, text_lang, lang, probability`` of every page."""
    spark = pages.sparkSession
    model = TextModel(docs)
    size = len(model.names)
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    declared = F.lower(F.coalesce(F.regexp_extract("html", r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})""", 1), F.lit("")))
    rows = pages.select("page_id", host.alias("host"), F.regexp_extract(host, r"([^.]*)$", 1).alias("suffix"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"), declared.alias("declared"), page_text(F.col("html")).alias("text"))
    if not size:
        return rows.select("page_id", "host", "declared", F.lit("und").alias("text_lang"), F.lit("und").alias("lang"), F.lit(0.0).alias("probability"))
    log = spark.sparkContext.broadcast(model.log)
    rows = rows.mapInArrow(_likelihoods(log, size), "page_id long, host string, suffix string, domain string, declared string, loglik array<double>")
    rows = stored(rows.withColumn("p", posterior(F.col("loglik"))), "lang-pages")
    total = rows.agg(*[F.coalesce(F.sum(F.get("p", F.lit(i))), F.lit(0.0)).alias(f"s{i}") for i in range(size)], F.count("*").alias("n")).first()
    sums, n = [total[f"s{i}"] for i in range(size)], total["n"]
    df = rows
    for by in ("declared", "suffix"):
        df = join_small(df, _evidence(rows, by, size, sums), [by])
    hosts = stored(_sums(rows, ["host", "domain", "suffix"], size, "host"), "lang-hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.array(*[F.sum(F.get("host_sum", F.lit(i))) for i in range(size)]).alias("domain_sum"), F.sum("host_n").alias("domain_n"))
    domains = stored(domains, "lang-domains")
    suffixes = stored(domains.groupBy("suffix").agg(F.array(*[F.sum(F.get("domain_sum", F.lit(i))) for i in range(size)]).alias("suffix_sum"), F.sum("domain_n").alias("suffix_n")), "lang-suffixes")
    tree = join_small(join_small(hosts, domains, ["domain", "suffix"]), suffixes, ["suffix"])
    tree = stored(tree.select("host", *(f"{x}_{y}" for x in STRENGTH for y in ("sum", "n"))), "lang-tree")
    df = join_small(df, tree, ["host"])
    prior = F.array(*[F.lit((s + 1) / (n + size)) for s in sums])
    for node in ("suffix", "domain", "host"):
        # The page's own soft count is left out of its prior.
        others = F.zip_with(f"{node}_sum", "p", lambda a, b: F.greatest(a - b, F.lit(0.0)))
        prior = _smoothed(others, prior, F.lit(STRENGTH[node]), F.col(f"{node}_n") - 1)
    df = df.withColumn("prior_log", F.transform(prior, lambda x: F.log(x)))
    fused = F.array(*[sum((F.get(c, F.lit(i)) for c in ("declared_log", "suffix_log", "prior_log")), F.get("loglik", F.lit(i))) for i in range(size)])
    df = df.withColumn("fused", posterior(fused))
    names = F.array(*map(F.lit, model.names))
    best = lambda p: F.get(names, (F.array_position(p, F.array_max(p)) - 1).cast("int"))
    return df.select("page_id", "host", "declared", best(F.col("p")).alias("text_lang"), best(F.col("fused")).alias("lang"), F.round(F.array_max("fused"), 6).alias("probability"))
