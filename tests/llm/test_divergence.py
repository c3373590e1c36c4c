"""Source divergence against its SQL and a plain recount, with blocks, pieces and bitmaps so small that all paths run."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = "doc_id long, text string, lang string, source string"


def rows_of(seed=1, n=240):
    rng = np.random.default_rng(seed)
    words = ["the", "The", "a", "Été", "été", "日本語", "dog", "dogs", "doghouse", "doghouses", "x" * 40, "x" * 41, "don't", "e-mail", "_a_b", "rare"] + [f"w{i}" + "abcdefgh"[i % 8] * (i % 30) for i in range(60)]
    weight = 1 / np.arange(1, len(words) + 1)
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words, size=int(rng.integers(0, 40)), p=weight / weight.sum()))
        lang = ["en", "de", None, "few"][int(rng.choice(4, p=[0.6, 0.2, 0.17, 0.03]))]
        rows.append((i, text if i % 17 else None, lang, None if i % 23 == 0 else f"s{int(rng.integers(0, 7)) if i % 3 else 0}"))
    rows += [(7, "the dog " * 3000, "en", "long"), (7, "the dog " * 3000, "en", "long"), (None, "", "en", "empty"), (1000, "y" * 9000 + " the", "en", "long")]
    return rows


def recounted(rows, least):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for _, text, lang, source in rows]
    held, count = Counter(), Counter()
    groups, out = defaultdict(set), []
    for lang, source, terms in docs:
        groups[lang].add(source)
        held.update({(lang, t) for t in terms})
        count.update((lang, source, t) for t in terms)
    for lang, sources in groups.items():
        kept = sorted(t for (x, t), n in held.items() if x == lang and n >= least)
        total = {t: sum(count[lang, s, t] for s in sources) for t in kept}
        size = {s: sum(count[lang, s, t] for t in kept) + 2 * len(kept) for s in sources}
        p = {s: [1 + 10**9 * (count[lang, s, t] + 2) // size[s] for t in kept] for s in sources}
        q = [1 + 10**9 * (total[t] + 2) // (sum(total.values()) + 2 * len(kept)) for t in kept]
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(map(f, p[s], p[o])), o.encode(), o) for o in sources if o != s)
            terms = sorted((-f(a, b), t.encode(), t) for t, a, b in zip(kept, p[s], q) if count[lang, s, t] and a > b)[:10]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_recount_and_sql(spark, small, monkeypatch):
    if small:
        for name, value in {"FIRST_LENGTH": 1, "MOST_BITS": 64, "SOURCES": 2, "TERMS": 3, "PIECE_BYTES": 64, "GATHERED": 50}.items():
            monkeypatch.setattr(divergence, name, value)
    rows = rows_of()
    docs = spark.createDataFrame(rows, COLUMNS)
    for name in ("n", "term", "total", "docs", "key", "kept", "number", "rank", "value"):
        docs = docs.withColumn(name, F.lit("clash"))
    got = sorted(map(tuple, divergence.source_divergence(docs.repartition(3)).collect()))
    assert got == recounted(rows, 10)
    assert {r[2] for r in got} == {"pair", "term"} and len({r[0] for r in got}) == 4
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?, ?)", rows)
    assert sorted(con.sql(divergence.SQL).fetchall()) == got


def test_no_rows_and_no_kept_terms(spark):
    assert divergence.source_divergence(spark.createDataFrame([], COLUMNS)).count() == 0
    rows = [(1, "one", "en", "a"), (2, None, "en", "b"), (3, "two", "de", None)]
    got = sorted(map(tuple, divergence.source_divergence(spark.createDataFrame(rows, COLUMNS)).collect()))
    assert got == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)] == recounted(rows, 10)


def test_pieces_cut_no_term():
    text = ("ab " * 5 + "c" * 50 + " d" * 9).encode()
    for limit in (1, 4, 7, 200):
        parts = list(divergence.pieces(text, limit))
        assert b"".join(parts) == text and [w for p in parts for w in p.split()] == text.split()


def test_probability_is_exact_beyond_64_bits(spark):
    rows = [(98_765_432_101_234, 98_765_432_109_999), (0, 4), (5, 7)]
    got = spark.createDataFrame(rows, "n long, size long").select(divergence.probability(F.col("n"), F.col("size")).alias("p"), "n", "size").collect()
    assert [r["p"] for r in got] == [1 + 10**9 * (r["n"] + 2) // r["size"] for r in got]
