"""The ten operators and the pipeline against brute force, round trips and held-out accuracy, with their edge cases."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import components, jaccard, language, mixing, pii, quality, queries, shared, substrings, tokens, toxicity, vectors, words

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega " * 3
ODD = [
    (1, LONG),
    (1, LONG),  # a repeated row
    (2, LONG),
    (3, None),
    (4, ""),
    (5, "   \n\t "),
    (6, "one two"),
    (7, "One TWO"),
    (None, LONG + " tail"),
    (8, "x" * 30_000),
    (9, "a " * 5_000),
    (10, "été ñandú 日本語 🙂   \u0085 end <|endoftext|> x"),
]


def documents(spark, rows=ODD, **extra):
    """Rows as documents, with columns whose names clash with those that the operators make."""
    df = spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("key", "class", "bucket", "n", "word", "ids", "found", "score", "_text", "_key"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def empty(spark):
    return documents(spark).limit(0)


def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def brute_substrings(rows, window=35):
    texts, count = [WORD.findall(t or "") for _, t in rows], Counter()
    for w in texts:
        count.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    for (d, _), w in zip(rows, texts):
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        yield d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()


def brute_components(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(lower))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    for i, (d, _) in enumerate(rows):
        ids = [x for x in least[find(i)] if x is not None]
        yield d, len(sets[i]), min(ids) if ids else None


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def given_rows(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("shard", [1000, 1])
def test_substrings(spark, shard, monkeypatch):
    whole = substrings.repeated_passages
    monkeypatch.setattr(substrings, "repeated_passages", lambda docs: whole(docs, shard))
    for rows in (ODD, given_rows(spark)):
        assert ordered(substrings.substring_digests(documents(spark, rows)).collect()) == ordered(brute_substrings(rows))
    assert substrings.substring_digests(empty(spark)).count() == 0


def test_substrings_of_a_crowded_passage_are_not_one_shard(spark, monkeypatch):
    """A passage of 60 words in all documents, with other neighbours in each: its windows are shared, its edge passages are not."""
    shared = " ".join(f"s{i}" for i in range(60))
    rows = [(d, " ".join([*(f"a{d}_{i}" for i in range(40)), shared, *(f"b{d}_{i}" for i in range(40))])) for d in range(300)]
    most, kind = [], type(documents(spark, rows))
    deal = kind.repartition

    def repartition(df, n, *columns):
        if columns == ("shard",):
            most.append(df.groupBy("shard").count().agg(F.max("count")).first()[0] or 0)
        return deal(df, n, *columns)

    monkeypatch.setattr(kind, "repartition", repartition)
    whole = substrings.repeated_passages
    monkeypatch.setattr(substrings, "repeated_passages", lambda docs: whole(docs, 20))
    assert ordered(substrings.substring_digests(documents(spark, rows)).collect()) == ordered(brute_substrings(rows))
    assert most and max(most) < 150


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), max_size=14), st.integers(1, 2)), min_size=1, max_size=5))
def test_suffix_automaton(passages):
    window, count = 3, Counter()
    for s, weight in passages:
        for i in range(len(s) - window + 1):
            count[tuple(s[i : i + window])] += weight
    expected = [[i for i in range(len(s) - window + 1) if count[tuple(s[i : i + window])] > 1] for s, _ in passages]
    assert substrings.repeated_starts(passages, window) == expected


def test_reference_spans(spark):
    item = " ".join(f"w{i}" for i in range(50))
    docs = documents(spark, [(1, "a b " + item + " c"), (2, "nothing"), (3, None)])
    found = substrings.reference_spans(docs, spark.createDataFrame([(item,), (None,)], "text string")).collect()
    assert ordered(found) == [(1, 2, 52)]


def test_jaccard(spark):
    rng = np.random.default_rng(3)
    base = [f"v{x}" for x in rng.integers(0, 500, 120)]
    near = []
    for i in range(25):
        w = list(base)
        for p in rng.integers(0, 120, rng.integers(0, 4)):
            w[p] = f"n{i}_{p}"
        near.append((100 + i, " ".join(w)))
    for rows in (ODD + near, given_rows(spark)):
        assert ordered(jaccard.jaccard_components(documents(spark, rows)).collect()) == ordered(brute_components(rows))
    assert jaccard.jaccard_components(empty(spark)).count() == 0


def test_prefix_join_alone_finds_all_links(spark):
    """Without the rounds with leaders, the prefix join must find every link itself."""
    rows = given_rows(spark)
    docs = documents(spark, rows).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    described, classes = jaccard.described(docs)
    rarity = spark.sparkContext.broadcast(np.zeros(jaccard.BUCKETS, dtype=np.int64))
    roots = {r["class"]: r["part"] for r in jaccard.class_parts(docs, classes, rarity, rounds=0).collect()}
    groups = defaultdict(list)
    for r in described.where("bucket is null").collect():
        groups[roots.get(r["class"], r["class"]) if r["n"] else ("none", r["doc_id"])].append(r["doc_id"])
    expected = defaultdict(list)
    for d, _, c in brute_components(rows):
        expected[c].append(d)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_deduplicated_keeps_one_of_each(spark):
    docs = documents(spark).withColumn("_key", F.concat(F.lit("keep "), "source"))
    kept = jaccard.deduplicated(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    # 1, 1, 2 and the null id are one group, of which the row of least id and text hash stays; 6 and 7 are another; texts without words all stay.
    assert sorted(r["doc_id"] for r in rows if r["doc_id"] not in (None, 1)) == [3, 4, 5, 6, 8, 9, 10]
    assert len(rows) == 8 and {r["_key"] for r in rows} == {"keep src1"} and {r["key"] for r in rows} == {"clash"}


def test_settled_family_is_sent_in_proportion(spark, monkeypatch):
    """Rows of one part are dropped; beside a few other parts a large part's rows travel once each for each of their blocks."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    sent = []
    for n in (100, 400, 1600):
        rows = spark.range(n).selectExpr("1L as token", "id as class", "if(id < 5, id, 9L) as part", "100 as n", "1 as place", "cast('' as binary) as marks", "0 as block", "64 as blocks")
        rows = rows.unionByName(rows.withColumn("token", F.lit(2).cast("long")).withColumn("part", F.lit(9).cast("long")))
        pairs = jaccard.block_pairs(rows)[0].select("token", "class", "part", "block", "p", "q").collect()
        assert {r["token"] for r in pairs} == {1}
        met = {(r["p"], r["q"]): [] for r in pairs}
        for r in pairs:
            met[r["p"], r["q"]].append(r)
        seen = {(a["class"], b["class"]) for g in met.values() for a in g for b in g if a["part"] < b["part"] and (a["p"] == a["q"] or a["block"] != b["block"])}
        assert len(seen) == 10 + 5 * (n - 5)
        sent.append(len(pairs))
    assert sent[2] < 20 * sent[0] and sent[2] < 3 * 1600


def test_family_of_copies_that_do_not_link_is_compared_in_blocks(spark, monkeypatch):
    """Documents that share a third of their words: many pairs meet, none but the planted ones may pass the filters."""
    rng = np.random.default_rng(4)
    base = [f"v{x}" for x in range(150)]
    rows = []
    for i in range(120):
        w = list(base)
        for p in rng.choice(150, 12, replace=False):
            w[p] = f"n{i}_{p}"
        rows.append((i, " ".join(w)))
    rows += [(500 + i, rows[i][1] + " tail") for i in range(0, 120, 10)]
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "SHARED_TOKENS", 0)
    assert ordered(jaccard.jaccard_components(documents(spark, rows)).collect()) == ordered(brute_components(rows))


def test_prefix_rows_are_of_possible_partners(spark):
    """Copies, and texts that share a passage but differ much in length, send no rows; texts of like length do."""
    shared = [f"s{i}" for i in range(30)]
    rows = [(1, " ".join([*shared, "x"])), (2, " ".join([*shared, "x"])), (3, " ".join([*shared, *(f"y{i}" for i in range(400))])), (4, " ".join([*shared, "z"]))]

    def sent(rows):
        docs = documents(spark, rows).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key")).repartition(4)
        described, classes = jaccard.described(docs)
        rarity = spark.sparkContext.broadcast(np.zeros(jaccard.BUCKETS, dtype=np.int64))
        return {r["n"] for r in jaccard.prefixes(docs, rarity, jaccard.further_copies(described, classes)).collect()}

    assert sent(rows[:2]) == sent(rows[:3]) == set()
    assert sent([rows[0], *rows[2:]]) >= {27} and sent([rows[0], rows[3]]) == {27}


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 200_000), st.data())
def test_sizes_that_link_are_two_bands_apart_at_most(n, data):
    m = data.draw(st.integers((jaccard.PERCENT * n + 99) // 100, n))
    a, b = jaccard.bands(np.array([m, n]))
    assert 0 <= a <= b <= min(a + 2, jaccard.BANDS - 1)


@pytest.mark.parametrize("shared_tokens", [0, 4_000_000])
def test_small_and_crowded_groups_together(spark, monkeypatch, shared_tokens):
    """Families of 2 to 40 near copies, of which some also occur as exact copies: links in small groups, in crowded ones and between both are all found."""
    monkeypatch.setattr(jaccard, "SHARED_TOKENS", shared_tokens)
    rng, rows = np.random.default_rng(7), []
    for family, size in enumerate([2, 3, 7, 8, 9, 10, 17, 40]):
        base = [f"f{family}_{i}" for i in range(int(rng.integers(40, 200)))]
        for i in range(size):
            w = list(base)
            for p in rng.choice(len(w), int(rng.integers(0, 3)), replace=False):
                w[p] = f"n{family}_{i}_{p}"
            w = w[: len(w) - int(rng.integers(0, 6))]
            rows += [(len(rows) + k, " ".join(w)) for k in range(1 + (i % 5 == 0))]
    assert ordered(jaccard.jaccard_components(documents(spark, rows)).collect()) == ordered(brute_components(rows))


def test_class_beside_a_large_part_meets_many_of_its_members(spark):
    """In a later round each class outside a family's large part gets several of that part's members as leaders, not one; members of the part meet each other never."""
    marks = bytes(jaccard.RANGES // 8 + 8 * jaccard.LEAST)
    rows = spark.range(30).crossJoin(spark.range(60).toDF("class")).selectExpr("id as token", "class", "if(class < 5, class, 9L) as part", "100 as n", "1 as place", "0 as block").withColumn("marks", F.lit(marks))
    pairs = jaccard.leader_pairs(rows, 1).collect()
    met = Counter(min(r["a"], r["b"]) for r in pairs if max(r["a"], r["b"]) >= 5)
    assert all(met[c] >= 4 for c in range(5)) and all(min(r["a"], r["b"]) < 5 for r in pairs)
    assert len(jaccard.leader_pairs(rows, 0).collect()) <= 60


def test_texts_go_to_python_in_small_batches(spark, monkeypatch):
    """Every query of the near-duplicate join that reads texts runs with bounded batches; the session's own setting is as before afterwards."""
    before, held, stored = spark.conf.get(shared.ARROW_BYTES), [], jaccard.stored
    monkeypatch.setattr(jaccard, "stored", lambda df, name: (held.append((name, spark.conf.get(shared.ARROW_BYTES))), stored(df, name))[1])
    jaccard.near_duplicates(documents(spark)).count()
    assert {name for name, _ in held} >= {"jaccard-rows", "jaccard-tokens", "jaccard-prefixes"} and {x for _, x in held} == {str(shared.BATCH_BYTES)}
    assert spark.conf.get(shared.ARROW_BYTES) == before

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    with shared.small_batches(spark):
        found = [r["n"] for r in spark.range(0, 4000, 1, 1).selectExpr("repeat('x', 4000) as text").mapInArrow(sizes, "n long").collect()]
    assert sum(found) >= 16_000_000 and max(found) < shared.BATCH_BYTES + 100_000


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=60), st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=60), st.sets(st.integers(0, 2**64 - 1), max_size=60))
def test_suffix_filter_drops_no_link(a, b, both):
    x, y = (np.array(sorted(s | both), dtype=np.uint64) for s in (a, b))
    common = jaccard.overlap(x, y)
    assert common == len(set(x.tolist()) & set(y.tolist()))
    marks = jaccard.parities(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]))
    if 100 * common >= 80 * (len(x) + len(y) - common):
        assert jaccard.may_link(marks[:1], marks[1:], np.array([len(x) + len(y)])).all()
        assert jaccard.sketches_may_link(jaccard.sketch(x), jaccard.sketch(y))


def test_sketches_tell_large_sets_apart():
    """At 5000 shingles 1024 ranges tell nothing; the sketches do, also of sizes on both sides of a power of two."""
    rng = np.random.default_rng(1)
    x, y = (np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2)) for n in (3900, 4400))
    marks = jaccard.parities(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]))
    assert jaccard.may_link(marks[:1], marks[1:], np.array([len(x) + len(y)])).all()
    assert len(jaccard.sketch(x)) < len(jaccard.sketch(y)) and not jaccard.sketches_may_link(jaccard.sketch(x), jaccard.sketch(y))
    near = np.union1d(x, y[:400])
    assert jaccard.sketches_may_link(jaccard.sketch(x), jaccard.sketch(near)) and jaccard.sets_link(x.tobytes(), near.tobytes())


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    roots = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert len({roots[i] for i in range(41)}) == 1 and roots[100] == roots[101] != roots[0] and len(roots) == 43


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=40), max_size=5))
def test_words(texts):
    raw = [t.encode() for t in texts]
    w = words.Words(raw)
    split = [[w.word(i) for i in range(w.first[k], w.first[k + 1])] for k in range(len(raw))] if raw else []
    assert split == [[x.encode() for x in WORD.findall(t)] for t in texts]


def test_bpe_is_the_library(spark):
    from tokenizers import Tokenizer

    path = tokens.tokenizer_path(spark)
    library = Tokenizer.from_file(path)
    rows = ODD + [(20, "foo  bar \n\n baz\t's 12² !!! the" + "the" * 100), (21, " lead"), (22, "trail \n")] + given_rows(spark)

    def expected(d, t):
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        return d, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    for most in (tokens.TABLE_BYTES, 3_000, 0):
        encoded = tokens.bpe_encode(documents(spark, rows), path, most)
        decoded = tokens.bpe_decode(encoded, path)
        got = decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long"), F.sha2("ids", 256), F.sha2("decoded", 256))
        assert ordered(got.collect()) == ordered(expected(*r) for r in rows)
    assert tokens.bpe_digests(empty(spark), path).count() == 0


def test_bpe_spans_of_odd_white_space(spark):
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    path = tokens.tokenizer_path(spark)
    bpe, library, pick = tokens.Bpe(path), Tokenizer.from_file(path), random.Random(5)
    signs = ["a", "b", " ", " ", "\n", "\t", "\u00a0", "\u2003", "\u3000", "\x1c", "\x85", "é", "’", "1", "²", "!", "'s", "<|endoftext|>", "日", "😀", "\u200b", "\u0301", "\x00"]
    texts = ["".join(pick.choice(signs) for _ in range(pick.randint(0, 14))) for _ in range(5000)] + [None, ""]
    known = {w: np.array(bpe.encode_word(w.encode()), dtype=bpe.width).tobytes() for w in ("a", " a", "b", " b", "!")}
    join = tokens.PositionJoin(known, bpe.special, bpe.width)
    ids, first = join.encoded(pa.array(texts))
    text, at, word = join.rare(pa.array(texts))
    found = {}
    for t, i, w in zip(text.tolist(), at.tolist(), word.to_pylist()):
        found.setdefault(t, []).append({"at": i, "ids": np.array(bpe.encode_word(w.encode()), dtype=bpe.width).tobytes()})
    for i, t in enumerate(texts):
        got = tokens._filled(ids[first[i] : first[i + 1]].tobytes(), found.get(i), bpe.width)
        assert np.frombuffer(got, dtype="<u4").tolist() == library.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_bpe_holes_when_the_memory_turns_within_a_text(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "MEMO_ENTRIES", 10)
    bpe = tokens.Bpe(tokens.tokenizer_path(spark))
    library = Tokenizer.from_file(tokens.tokenizer_path(spark))
    text = " ".join(f"first zq{i} wx{i % 7}" for i in range(60)) + " " + " ".join(f"zq{i % 13} first" for i in range(200))
    words = sorted({w for s in tokens.Splitter(list(bpe.special)).spans(text) for w in tokens.Splitter([]).find(s)})
    for known in ([], words[::3], words):
        table = {w: np.array(bpe.encode_word(w.encode()), dtype=bpe.width).tobytes() for w in known}
        join = tokens.PositionJoin(table, bpe.special, bpe.width)
        for _ in range(2):
            ids, rare = join.ids(text)
            found = [{"at": i, "ids": np.array(bpe.encode_word(w.encode()), dtype=bpe.width).tobytes()} for i, w in enumerate(rare)]
            assert np.frombuffer(tokens._filled(ids, found, bpe.width), dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_long_and_short_merges_agree(spark):
    bpe = tokens.Bpe(tokens.tokenizer_path(spark))
    for w in (b"the" * 40, b" internationalisation", bytes(range(256)), b"aaaaaaab" * 9):
        parts = [w[i : i + 1] for i in range(len(w))]
        assert bpe._merge_short(list(parts)) == bpe._merge_long(list(parts))


PIECES = [b"a", b"ab", b"abc", b"bcd", b"b", b"c", b"d", b"cdab"]


@settings(max_examples=200, deadline=None)
@given(st.text("abcde", max_size=20))
def test_longest_match(word):
    def greedy(w):
        n = 0
        while w:
            piece = max((p for p in PIECES if w.startswith(p)), key=len, default=None)
            if piece is None:
                return None
            w, n = w[len(piece) :], n + 1
        return n

    assert tokens.LongestMatch(PIECES).count(word.encode()) == greedy(word.encode())


def test_token_counts(spark):
    path = tokens.tokenizer_path(spark)
    got = {r["doc_id"]: (r["n_words"], r["n_pieces"]) for r in tokens.token_counts(documents(spark), path).collect()}
    assert got[3] == got[4] == got[5] == (0, 0) and got[6][0] == 2 and got[9] == (5_000, 5_000)
    assert tokens.token_counts(empty(spark), path).count() == 0


def base_row(t):
    t = t or ""
    w = WORD.findall(t)
    seen, same = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            same += line in seen
            seen.add(line)
    grams, covered = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if grams[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), same, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_quality_base(spark):
    rows = ODD + [(30, "a b c\n\na b c\nd | # <x>\na b c")] + given_rows(spark)
    got = quality.quality_rules(documents(spark, rows), no_labels(spark))
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert ordered((r["doc_id"], *(r[c] for c in columns)) for r in got.collect()) == ordered((d, *base_row(t)) for d, t in rows)
    assert quality.quality_rules(empty(spark), no_labels(spark)).count() == 0


def test_quality_separates_labels(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    df = quality.quality_rules(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), labels).join(labels, "doc_id").where("not base_failed")
    rows = df.select("quality", "kept").collect()
    good, bad = [r["kept"] for r in rows if r["quality"] == 1], [r["kept"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.2


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(t):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, t or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")), "card": lambda: 14 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 10 <= len(digits) <= 15}[kind]()  # noqa: B023
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


PII = [
    "x a@b.c_foo@z.org a@b@c.de .a.@-.-. @ a@b",
    "1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.0255 1.2.3 9.9.9.9.9",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111112 5 4111111111111111 41111111111111110000 1234",
    "+1 (017) 555-7713 +12345 ++49 30 1234567890 +1 2.3.4.5 6789 +1((((",
    "9" * 3000 + " " + "a" * 3000 + "@" + ".b" * 2000 + " " + "1.1.1.1 " * 700,
    "é日本🙂 me@x.org 🙂 +1 (017) 555-7713",
    None,
    "",
]


def test_pii_base(spark):
    rows = list(enumerate(PII)) + [(None, "a@b.cd"), (0, PII[0])] + [(d + 100, t) for d, t in given_rows(spark)]
    got = pii.personal_data(documents(spark, rows)).collect()

    def expected(d, t):
        spans = base_spans(t)
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        return d, *(sum(s[3] == k for s in spans) for k in PATTERNS), hashlib.sha256(joined.encode()).hexdigest()

    assert ordered((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == ordered(expected(*r) for r in rows)
    assert pii.personal_data(empty(spark)).count() == 0


def test_pii_runs_no_python(spark, monkeypatch):
    seen, kept = [], pii.stored
    monkeypatch.setattr(pii, "stored", lambda df, name: seen.append(df) or kept(df, name))
    for df in (pii.personal_data(documents(spark)), pii.redact(documents(spark)), *seen):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan
    assert len(seen) > 5


def test_redaction(spark):
    rows = [(1, "é mail me@x.org now +1 (017) 555-7713!"), (2, None), (3, "clean"), (4, "+1 2.3.4.5 67890")]
    out = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pii.redact(documents(spark, rows)).collect()}
    assert out[1] == ("é mail [EMAIL] now [PHONE]!", len("é mail [EMAIL] now [PHONE]!")) and out[2][0] is None and out[3] == ("clean", 5)
    assert "2.3.4.5" not in out[4][0]


def test_trees_add_masked_spans(spark):
    """Plain and broken addresses and numbers teach the trees; masked ones in the same places are added, broken ones are not."""
    rng = np.random.default_rng(8)
    card = lambda head: next(head + str(x) for x in range(10) if luhn(head + str(x)))
    rows = []
    for i in range(1200):
        n = rng.integers(1, 250, 8)
        good = [f"und.{n[0]}@mail{n[1]}.example.com", ".".join(map(str, n[:4])), card("4" + "".join(map(str, rng.integers(0, 10, 14)))), f"+49 (0{n[5] + 10}) 555-{n[6] + 1000}"]
        number = card("7" + "".join(map(str, rng.integers(0, 10, 14))))
        bad = [f"no/und at home{n[0]} dot here", f"no/{n[0]}.{n[1]}.{n[2] + 300}.{n[3]}", number[:-1] + str((int(number[-1]) + 1) % 10), f"no/{n[5] + 100} {n[6] + 1000}"]
        rows.append((i, f"some words {good[i % 4]} and more of them, then {bad[i % 4]} at the end"))
    masked = ["mail a (at) b (dot) org now", "node 10[.]1[.]2[.]3 is up", "call 0049 (017) 555-7713 now", "pay 4111.1111.1111.1111 now", "me x.y at mail dot com or", "code 123456789012 here"]
    rows += [(5000 + i, f"some words {x}") for i, x in enumerate(masked)]
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(documents(spark, rows)).collect()}
    found = [got[5000 + i] for i in range(len(masked))]
    at = lambda i, part: (len("some words ") + masked[i].index(part), len("some words ") + masked[i].index(part) + len(part))
    expected = [("email", "a (at) b (dot) org"), ("ip", "10[.]1[.]2[.]3"), ("phone", "0049 (017) 555-7713"), ("card", "4111.1111.1111.1111"), ("email", "x.y at mail dot com")]
    assert found == [*("{}:{}:{}".format(k, *at(i, part)) for i, (k, part) in enumerate(expected)), ""]
    for d, t in rows[:1200]:
        assert got[d] == ",".join(f"{k}:{a}:{b}" for a, _, b, k in base_spans(t))
    texts = {r["doc_id"]: r["text"] for r in pii.redact(documents(spark, rows)).collect()}
    assert texts[5000] == "some words mail [EMAIL] now" and texts[5003] == "some words pay [CARD] now"


def test_many_addresses_in_one_text(spark):
    """Spans, features and redaction are linear in a text's matches."""
    n = 32_000
    docs = documents(spark, [(1, " ".join(f"a{i}@b.cd" for i in range(n)))])
    assert pii.personal_data(docs).first()["n_email"] == n
    assert pii.redact(docs).first()["text"] == " ".join(["[EMAIL]"] * n)


def test_boosting_learns_an_interaction():
    cells = {c: (90, 10) if (c & 1) != (c >> 1 & 1) else (10, 90) for c in range(4)}
    model = pii.Boosted(cells)
    assert model.score(1) > 0 > model.score(0) and model.score(2) > 0 > model.score(3)
    assert pii.lowest_threshold(model, {1: (30, 0), 0: (0, 30)}) == model.score(1)


def test_toxicity_channel(spark):
    letters = toxicity.letter_model(spark.createDataFrame([("the idiot and the moron are stupid losers " * 20,), (None,)], "text string"))
    channel = toxicity.Channel(letters)
    assert [channel.decode(x) for x in ("1d10t", "i.d.i.o.t", "stuuuupid", "m0r0n", "idiot")] == ["idiot", "idiot", "stupid", "moron", "idiot"]
    assert "s p a c e d" in toxicity.Features.tokens("it is s p a c e d out")
    features = toxicity.Features(letters)
    assert "=idiot" in set(features.inside("y o u s t u p i d i d i o t")) and "=stupid" in set(features.inside("y.0.u.s.t.u.p.i.d.i.d.i.o.t"))
    assert "i d i o t" in features.tokens("you are a i d i o t")
    assert "=loss" in features.of_token("lo$$") and "=idiot" in features.of_token("(idiot!),")
    assert len(features.channel.decode("i.d.i.o.t." * 5_000)) == 25_000


def test_toxicity_known_features_are_those_of_all(spark):
    """Plain words are looked up by their beginnings, without their features being made: the same ones are found, and none are made for other words."""
    features = toxicity.Features(toxicity.letter_model(spark.createDataFrame([("the idiot and the moron are stupid losers " * 20,)], "text string")))
    tokens = ["Idiot", "idiot,", "idiots.", "idiot!", "(idiot)", "1d1ot", "i.d.i.o.t", "idiooot", "idiooot,", "moron?;", "MORONIC", "stu", "st", "\u0130diot", "_idiot_", "idiot's", "\u00e9t\u00e9", "word...", "...", "", "3"]
    every = {f for t in tokens for f in features.of_token(t)}
    for wanted in (set(), {"=idiot", "^idi", "^moro", "=stu"}, every):
        heads = features.heads(wanted)
        for t in tokens:
            assert set(features.known(t, wanted, heads)) == set(features.of_token(t)) & wanted
        text = " ".join(tokens)
        assert features.of_text(text, {}, wanted, heads) == features.of_text(text, {}) & wanted
    made = []
    features.of_word = lambda word: made.append(word) or []
    features.known("Letters,", {"=idiot"}, {"idi"})
    assert not made


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.ToxicityModel(docs, labels)
    chosen = docs.join(labels.where("toxic is not null"), "doc_id").where(toxicity._remainder() == 2)
    rows = model.score(chosen.select("toxic", "lang", "text")).collect()
    toxic = [r["score"] >= toxicity.THRESHOLD for r in rows if r["toxic"] == 1]
    clean = [r["score"] >= toxicity.THRESHOLD for r in rows if r["toxic"] == 0]
    assert np.mean(toxic) > 0.75 and np.mean(clean) < 0.05
    hidden = spark.createDataFrame([(" ".join(["the and of to"] * 20) + " " + w,) for w in ("1d10t", "i d i o t", "iiidiooot", "y o u a r e a n i d i o t", " ".join("anidiot" * 300), "the")], "text string")
    scores = [r["score"] for r in model.score(hidden.withColumn("k", F.lit(1))).collect()]
    assert min(scores[:5]) > 0.3 > scores[5]


def test_toxicity_edges(spark):
    got = toxicity.toxicity(documents(spark), no_labels(spark)).collect()
    assert len(got) == len(ODD) and all(r["score"] == 0 and r["predicted"] == 0 for r in got)
    assert toxicity.toxicity(empty(spark), no_labels(spark)).count() == 0
    kept = toxicity.without_toxic(documents(spark), no_labels(spark))
    assert kept.columns == documents(spark).columns and kept.count() == len(ODD)


def test_mixing_sql(spark):
    db = duckdb.connect()
    db.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    expected = db.execute(mixing.SQL)
    columns = [d[0] for d in expected.description]
    assert ordered(queries.op1_mixing(spark, SF).select(*columns).collect()) == ordered(expected.fetchall())


def test_mixing_fills_siblings_before_ancestors(spark):
    leaves = spark.createDataFrame([("d0", "en", "a", 100), ("d0", "en", "b", 1000), ("d1", "en", "c", 1000)], "domain string, lang string, source string, tokens long")
    out = mixing.leaf_amounts(leaves, {"domain": {}, "lang": {}, "source": {}}, 50, 1)
    # 1050 tokens: 525 for each domain; a can give 100, so its sibling b gives the rest of d0's share.
    assert {r["source"]: r["amount"] for r in out.collect()} == {"a": 100, "b": 425, "c": 525}


def test_mixing_takes_the_budget(spark):
    docs = documents(spark, [(i, "w " * (1 + i % 7)) for i in range(300)] + ODD)
    rows = mixing.mix(docs, percent=60, max_epochs=2).collect()
    total = sum(r["n_tokens"] for r in rows)
    taken = sum(r["taken_tokens"] for r in rows)
    assert total * 60 // 100 - 3 <= taken <= total * 60 // 100
    assert mixing.mix(empty(spark)).count() == 0
    mixed = mixing.mixed_documents(docs, percent=60, max_epochs=2)
    assert mixed.columns == docs.columns
    assert sum(len(WORD.findall(r["text"])) for r in mixed.collect()) == taken


def vector_table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("class", F.lit("clash"))


def brute_vectors(rows):
    ok = [i for i, (_, e, _) in enumerate(rows) if e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    unit = {i: np.array(rows[i][1], dtype=np.float32).astype(float) for i in ok}
    unit = {i: x / np.linalg.norm(x) for i, x in unit.items()}
    links, root = defaultdict(set), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ok:
        for b in ok:
            if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9:
                links[a].add(b)
                links[b].add(a)
                root[find(a)] = find(b)
    for i, (v, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        c = min(ids) if ids else None
        yield v, len(links[i]), c, v is not None and v == c


@pytest.mark.parametrize("block", [2048, 8])
def test_vectors(spark, block, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng, rows = np.random.default_rng(5), []
    for g in range(6):
        centre = rng.standard_normal(64)
        rows += [(len(rows) + i, (centre + 0.3 * rng.standard_normal(64)).astype(np.float32).tolist(), g) for i in range(20)]
    rows += [(200, rows[0][1], 1), (201, rows[0][1], 1), (201, rows[0][1], 1), (None, rows[5][1], 0), (202, None, 0), (203, [], 0), (204, [0.0] * 64, 0), (205, [float("nan")] * 64, 0), (206, [None] + [1.0] * 63, 0), (207, [1.0, 2.0, 3.0], 0), (208, [2.0, 4.0, 6.0], 0), (209, [5.0], 0)]
    assert ordered(vectors.near_vectors(vector_table(spark, rows)).collect()) == ordered(brute_vectors(rows))
    assert vectors.near_vectors(vector_table(spark, rows).limit(0)).count() == 0


def test_vectors_with_odd_components(spark):
    """Twins that differ in a null, a NaN or a zero's sign alone: nulls and NaN link with nothing, the zeros are the same."""
    rng, rows = np.random.default_rng(11), []
    for i in range(40):
        v = rng.integers(-2, 3, size=5).astype(float).tolist()
        at = int(rng.integers(0, 6))
        for odd in (None, float("nan"), 0.0, -0.0):
            rows.append((len(rows), [*v[:at], odd, *v[at:]], 0))
        rows.append((len(rows), v, 0))
    rows += [(900, [1.0, 2.0], 0), (901, [1.0, None, 2.0], 0), (902, [1.0, 2.0], 0)]
    assert ordered(vectors.near_vectors(vector_table(spark, rows)).collect()) == ordered(brute_vectors(rows))


def test_vectors_recall():
    """Pairs at cosine 0.9 exactly, the hardest ones, share a filter."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((400, 64))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(0.19) * y / np.linalg.norm(y, axis=1, keepdims=True)
    code = vectors.Filters(64)
    met = [bool(set(a) & set(b)) for a, b in zip(code.of(x), code.of(y))]
    assert np.mean(met) > 0.98


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = language.identify(pages, docs).join(pages.select("page_id", F.regexp_extract("url", "://[^/]+/([a-z]{2})/", 1).alias("path")), "page_id").where("path <> ''").collect()
    assert np.mean([r["lang"] == r["path"] for r in rows]) > 0.95
    odd = spark.createDataFrame([(1, None, None), (None, "x", ""), (2, "http://h.example/", "<p>"), (2, "http://h.example/", "<p>")], "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    assert language.identify(odd, docs).count() == 4
    assert {r["lang"] for r in language.identify(odd, docs.limit(0)).collect()} == {"und"}
    assert language.identify(odd.limit(0), docs).count() == 0


def test_page_evidence_outweighs_a_short_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = docs.where("lang = 'de'").orderBy("doc_id").limit(30).select("text")
    german = text.select(F.monotonically_increasing_id().alias("page_id"), F.lit("https://h.example.de/").alias("url"), F.concat(F.lit('<html lang="de"><p>'), "text").alias("html"))
    short = spark.createDataFrame([(999_999_999_999, "https://h.example.de/", '<html lang="de"><p>a')], "page_id long, url string, html string")
    out = language.identify(german.unionByName(short), docs).where("page_id = 999999999999").first()
    assert out["lang"] == "de"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        docs = docs.persist()
        assert name == "mixing" or docs.count() <= before
    final = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert final.count() == docs.count()
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


@pytest.mark.parametrize("stage", range(4))
def test_stages_pass_on_columns_of_any_name(spark, stage):
    docs = documents(spark, ODD)
    for name in ("a.b", "back`tick", "row", "row_id", "digest", "taken", "best", "n_tokens", "__mix_id", "_keep_0", "new", "two words"):
        docs = docs.withColumn(name, F.struct(F.lit(name).alias("x.y")))
    out = corpus_pipeline.STAGES[stage][1](spark, docs, SF)
    assert out.columns == docs.columns
    for row in out.collect():
        assert row["a.b"] == ("a.b",) and row["back`tick"] == ("back`tick",) and row["__mix_id"] == ("__mix_id",) and row["key"] == "clash"


def test_every_operator_has_one_query():
    assert [f"op{n}" for n in range(1, 14)] == [q.split("_")[0] for q in queries.QUERIES]
    assert set(queries.SQL) <= set(queries.QUERIES)
