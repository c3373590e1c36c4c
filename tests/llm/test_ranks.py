"""Byte-level BPE by ranks against the library, and its round trip."""

import hashlib
import random as rnd

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import ranks, tokens

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.read_ranks(PATH), special_tokens={})
BPE = ranks.RankBpe(ranks.read_ranks(PATH))
ODD = [
    (1, "The cat's  mat,\n\n  isn't\there 1234 ... "),
    (1, "The cat's  mat,\n\n  isn't\there 1234 ... "),
    (2, None),
    (3, ""),
    (4, "   \n\t "),
    (None, "été ñandú 日本語 🙂 \u0085 end <|endoftext|> x\x00\x1c y"),
    (5, "x" * 30_000),
    (6, "ab" * 9_999 + "　" + "日" * 5_000),
    (7, " thatble" * 4_000),
]


def expected(rows):
    for d, t in rows:
        ids = LIBRARY.encode_ordinary(t or "")
        raw = np.array(ids, dtype="<u4").tobytes()
        yield d, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()


def numbers(*ids):
    return np.frombuffer(b"".join(ids), dtype="<u4").tolist()


def slow(word):
    """The pair of the lowest rank, the leftmost first, again and again."""
    if word in BPE.ranks:
        return [BPE.ranks[word]]
    parts = [word[i : i + 1] for i in range(len(word))]
    while pairs := [(BPE.ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in BPE.ranks]:
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [BPE.ranks[p] for p in parts]


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def test_digests_equal_the_library(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit("clash"))
    assert ordered(ranks.rank_digests(docs, PATH).collect()) == ordered(expected(ODD))
    assert ranks.rank_digests(docs.limit(0), PATH).count() == 0


def test_digests_of_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = ranks.rank_digests(docs.repartition(3), PATH).collect()
    assert ordered(got) == ordered(expected(docs.select("doc_id", "text").collect()))


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("aab éth", max_size=200), st.text("nation", min_size=20, max_size=400)))
def test_words_equal_the_library(text):
    split = tokens.Splitter([])
    words = [w for span in split.spans(text) for w in tokens._words(span, split.find)]
    assert "".join(words) == text
    assert numbers(*BPE.encode_words([w.encode() for w in words])) == LIBRARY.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab", min_size=2, max_size=5).map(str.encode), unique=True, max_size=12), st.text("ab", min_size=1, max_size=40).map(str.encode), st.randoms())
def test_ranks_in_any_order(found, word, random):
    """Ranks need not grow with the tokens' lengths: a merge may make a pair of a lower rank than its own."""
    vocabulary = [b"a", b"b", *found]
    random.shuffle(vocabulary)
    known = {t: i * 97 for i, t in enumerate(vocabulary)}
    parts = [word[i : i + 1] for i in range(len(word))]
    while word not in known and (pairs := [(known[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in known]):
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    want = [known[word]] if word in known else [known[p] for p in parts]
    others = [word[::-1], b"a", word[:3], b"ba"]
    assert numbers(ranks.RankBpe(known).encode_words([*others, word, *others])[4]) == want


def test_pattern_is_the_files_own():
    assert tokens.PRETOKEN == public_tokenizers.PATTERN


def test_memo_starts_anew(monkeypatch):
    monkeypatch.setattr(ranks, "MEMO_ENTRIES", 3)
    ids = ranks.WordIds(BPE, tokens.Splitter([]).find)
    for spans in (["one", " two.", "three"], ["thatble", "one"], [" two.", "..."], []):
        assert [numbers(x) for x in ids.of_spans(spans)] == [LIBRARY.encode_ordinary(x) for x in spans]
        assert len(ids) <= 6


def test_many_words_through_one_queue():
    random = rnd.Random(3)
    words = ["".join(random.choice("abcehnotirsé\0 ") for _ in range(random.choice([1, 2, 3, 5, 8, 13, 40, 200]))) for _ in range(3000)]
    assert [numbers(x) for x in BPE.encode_words([w.encode() for w in words])] == [slow(w.encode()) for w in words]
    assert BPE.encode_words([]) == []


def test_unknown_id_is_an_error(spark):
    from pyspark.errors import PySparkException

    bad = spark.createDataFrame([(1, bytearray(b"\xff\xff\xff\x00"))], "doc_id long, ids binary")
    with pytest.raises(PySparkException):
        ranks.rank_decode(bad, PATH).collect()
