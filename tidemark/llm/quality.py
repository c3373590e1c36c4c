"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

The target's and the raw corpus's unigrams and bigrams are counted in a fixed number of hash buckets over **all** documents; a
document's score is the mean over its n-grams of ``log p_target - log p_raw``. The threshold is the bucketed quantile of the
trusted documents' own scores, so it depends on counts alone, never on row order or partitioning.

Edge cases: a null or empty text has no words, counts 0 everywhere, score 0.0, and fails the base rule. Repeated rows are
scored alike, each on its own. With an empty table or no trusted document every ratio is 0 and only the base rule decides.
Extra columns are ignored. A null ``doc_id`` is kept and never matches a label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import join_small, stored
from .words import Powers, Words, chunks, gram_hashes, slices, utf8

N_BUCKETS = 1 << 15
SCORE_BINS = 2000
SCORE_RANGE = 10.0
TARGET_QUANTILE = 0.01
SYMBOLS = b"#*$%&|<>"


def _grams(w: Words, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text index of each unigram and bigram."""
    h = w.hashes(powers)
    two = gram_hashes(h, 2)
    inside = w.doc[1:] == w.doc[:-1] if len(w) > 1 else np.zeros(0, dtype=bool)
    bucket = np.concatenate([h, two[inside]]) % np.uint64(N_BUCKETS)
    return bucket.astype(np.int64), np.concatenate([w.doc, w.doc[1:][inside]])


def _count_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers, counts = Powers(), np.zeros((2, N_BUCKETS), dtype=np.int64)
    for batch in slices(batches):
        trusted = np.array(batch.column("trusted").to_pylist(), dtype=bool)
        texts = utf8(batch.column("text"))
        for first, part in chunks(texts):
            bucket, doc = _grams(Words(part), powers)
            counts[0] += np.bincount(bucket, minlength=N_BUCKETS)
            counts[1] += np.bincount(bucket[trusted[first + doc]], minlength=N_BUCKETS)
    used = np.flatnonzero(counts[0])
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[0][used]), pa.array(counts[1][used])], names=["bucket", "raw", "target"])


def bucket_counts(docs: DataFrame) -> DataFrame:
    """``(bucket, raw, target)`` over all rows of ``docs(text, trusted)``; at most ``N_BUCKETS`` rows."""
    partial = docs.select("text", "trusted").mapInArrow(_count_buckets, "bucket long, raw long, target long")
    return partial.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """Smoothed log p_target - log p_raw of each bucket. ``counts`` has at most N_BUCKETS rows, so it may come to the driver."""
    rows = counts.toArrow()
    raw, target = np.ones(N_BUCKETS), np.ones(N_BUCKETS)
    index = rows.column("bucket").to_numpy()
    raw[index] += rows.column("raw").to_numpy()
    target[index] += rows.column("target").to_numpy()
    if target.sum() == N_BUCKETS:
        return np.zeros(N_BUCKETS)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def repeated_window_words(ids: np.ndarray, n_distinct: int) -> int:
    """Words covered by a 3-word window that is found twice or more; ``ids`` are exact local word numbers."""
    if len(ids) < 4:
        return 0
    a, b, c = ids[:-2], ids[1:-1], ids[2:]
    if n_distinct < 2_000_000:
        key = (a * n_distinct + b) * n_distinct + c
    else:
        pair = np.unique(a * np.int64(n_distinct) + b, return_inverse=True)[1]
        key = pair * np.int64(n_distinct) + c
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[inverse] > 1)
    covered = np.zeros(len(ids), dtype=bool)
    for j in range(3):
        covered[starts + j] = True
    return int(covered.sum())


def base_features(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one whole text (UTF-8)."""
    words = text.split()
    n_bytes, n_more = sum(map(len, words)), len(text) - len(text.translate(None, bytes(range(0x80, 0xC0))))
    n_symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()] if b"\n" in text else []
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(x, len(number)) for x in words), dtype=np.int64, count=len(words))
    return len(words), n_bytes - n_more, n_symbols, len(lines) - len(set(lines)), repeated_window_words(ids, len(number))


def _features(ratios: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in slices(batches):
            texts = utf8(batch.column("text"))
            total, n = np.zeros(len(texts)), np.zeros(len(texts))
            for first, part in chunks(texts):
                bucket, doc = _grams(Words(part), powers)
                # Integers, so that sums do not depend on their order.
                total[first : first + len(part)] = np.bincount(doc, np.rint(ratios[bucket] * 2**20), minlength=len(part))
                n[first : first + len(part)] = np.bincount(doc, minlength=len(part))
            rows = [base_features(x) for x in texts]
            columns = [pa.array(x, pa.int64()) for x in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5
            score = np.divide(total / 2**20, n, out=np.zeros(len(texts)), where=n > 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("trusted"), *columns, pa.array(score)], names=FEATURES)

    return run


FEATURES = ["doc_id", "trusted", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr"]


def threshold(scored: DataFrame, quantile: float = TARGET_QUANTILE) -> float:
    """Lower edge of the score bin that holds the trusted documents' ``quantile``; bins are fixed, so the result is exact."""
    bin_of = F.floor((F.greatest(F.lit(-SCORE_RANGE), F.least(F.lit(SCORE_RANGE), "llr")) + SCORE_RANGE) * (SCORE_BINS / (2 * SCORE_RANGE)))
    rows = scored.where("trusted and n_words > 0").groupBy(bin_of.alias("bin")).count().collect()  # at most SCORE_BINS + 1 rows
    left = quantile * sum(r["count"] for r in rows)
    for r in sorted(rows, key=lambda r: r["bin"]):
        left -= r["count"]
        if left < 0:
            return r["bin"] * (2 * SCORE_RANGE / SCORE_BINS) - SCORE_RANGE
    return -SCORE_RANGE


def quality_rules(docs: DataFrame, labels: DataFrame, quantile: float = TARGET_QUANTILE) -> DataFrame:
    """Every document with its base counts, ``llr``, ``base_failed`` and ``kept``. Trusted: labelled quality 1."""
    trusted = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().withColumn("trusted", F.lit(True))
    trusted = stored(trusted, "quality-trusted")
    docs = join_small(docs.select("doc_id", "text"), trusted, ["doc_id"], "left").select("doc_id", "text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    ratios = log_ratios(bucket_counts(docs))
    schema = "doc_id long, trusted boolean, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, llr double"
    scored = stored(docs.mapInArrow(_features(ratios), schema), "quality-scored")
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("llr") >= threshold(scored, quantile))).drop("trusted")
