"""Source divergence audit: how each source's words differ from those of its language and of the language's other sources.

Terms are runs of letters A-Z and of characters beyond ASCII, with A-Z lowered. A language keeps the terms that at least ``LEAST`` of its documents hold. They
are found by iceberg refinement: each pass reads the texts and counts the distinct documents of each (language, byte prefix) of one length, a longer one each
time, of those terms only whose shorter prefix was held by enough documents. A term that ends within a prefix's length is complete there. Passes end when no
prefix that is kept goes on; a last one counts the complete terms. A document lies in one task, so a prefix's documents are a sum, and counts are summed in
tasks before they are shuffled. What one pass tells the next is a bitmap of hashed prefixes with 16 bits a prefix, ``MOST_BITS`` at most: a chance hit, or a
fuller bitmap, lets a rare prefix through to the next count but never holds a frequent one back, and the last count is by whole terms, so results are exact
at any size.

Probabilities and divergences are integers, as the contract fixes them. The divergences of all pairs of a language's sources, as many as its result has rows,
are summed over blocks: a task takes ``SOURCES`` times ``SOURCES`` sources and about ``TERMS`` terms as a matrix and returns sums, never pairs by term.

Edge cases: null text, lang and source are read as ''. Rows are documents: repeated rows count as often as they stand there. Groups without terms have their
pairs, and no terms; a language without kept terms has pairs of value 0. Texts may be of any length: long ones are read in pieces, and count as one document.
Ties are broken by UTF-8. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, join_small, stored
from .words import Powers, mixed, portions, utf8

#: Documents of its language that a kept term stands in at least, and how many of a group's terms are reported.
LEAST, MOST_TERMS = 10, 10
#: The first prefix length in bytes; each later one is twice as long.
FIRST_LENGTH = 6
MOST_BITS = 1 << 27
#: Sources and terms of a block of divergences.
SOURCES, TERMS = 128, 4096
PIECE_BYTES = 1 << 20
#: Counts that a task gathers before it adds them up.
GATHERED = 1 << 20
SCALE = 1_000_000_000

_IS_TERM = np.zeros(256, dtype=bool)
_IS_TERM[0x41:0x5B] = _IS_TERM[0x61:0x7B] = _IS_TERM[0x80:] = True
_LOWER = bytes(b + 32 if 0x41 <= b < 0x5B else b for b in range(256))


class Terms:
    """Terms of several texts: byte offsets into ``data``, and the index of the text of each term."""

    def __init__(self, texts: list[bytes], powers: Powers) -> None:
        self.data = (b"\n".join(texts) + b"\n").translate(_LOWER)
        self.bytes, self.powers = np.frombuffer(self.data, dtype=np.uint8), powers
        edge = np.flatnonzero(np.diff(_IS_TERM[self.bytes], prepend=False))
        self.start, self.end = edge[::2], edge[1::2]
        ends = np.cumsum([len(x) + 1 for x in texts])
        self.doc = np.searchsorted(ends, self.start, side="right")
        self._sums = None

    def keys(self, length: int, salts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A hash of each term's first ``length`` bytes, its end counting as one, under its text's salt; and whether the term goes on after them."""
        up, down = self.powers.to(len(self.bytes) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self.bytes) + 1, dtype=np.uint64)
            np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * up[: len(self.bytes)], out=self._sums[1:])
        goes_on = self.end - self.start >= length
        h = mixed((self._sums[np.minimum(self.end, self.start + length)] - self._sums[self.start]) * down[self.start])
        return mixed(h ^ salts[self.doc] ^ goes_on.astype(np.uint64)), goes_on

    def take(self, chosen: np.ndarray) -> pa.Array:
        """The chosen terms as a column."""
        edges = np.stack([self.start, self.end], axis=1).ravel()
        offsets = np.append(edges, len(self.data)).astype(np.int32)
        runs = pa.Array.from_buffers(pa.binary(), len(edges), [None, pa.py_buffer(offsets), pa.py_buffer(self.data)])  # term, gap, term, gap ...
        return runs.take(pa.array(2 * chosen))


def pieces(text: bytes, limit: int) -> Iterator[bytes]:
    """A long text in parts of about ``limit`` bytes that cut no term."""
    first, gap = 0, ~_IS_TERM[np.frombuffer(text, dtype=np.uint8)]
    while len(text) - first > limit:
        inside, after = np.flatnonzero(gap[first : first + limit]), gap[first + limit :]
        cut = int(inside[-1]) + 1 if len(inside) else limit + (int(np.argmax(after)) if after.any() else len(after))
        yield text[first : first + cut]
        first += cut
    yield text[first:]


def sums_by_key(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1)) if len(keys) else order
    return keys[at], *(np.add.reduceat(v[order], at) if len(at) else v for v in values)


def _salts(langs: list[str]) -> np.ndarray:
    known: dict[str, int] = {}
    for x in set(langs):
        known[x] = int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little")
    return np.array([known[x] for x in langs], dtype=np.uint64)


def _texts(batches: Iterator[pa.RecordBatch], limit: int):
    """``(batch, texts, index of the row of each text, is it a part of one long text)``."""
    for batch in portions(batches, "text", limit):
        texts = utf8(batch.column("text"))
        if len(texts) == 1 and len(texts[0]) > limit:
            for piece in pieces(texts[0], limit):
                yield batch, [piece], True
        else:
            yield batch, texts, False


class Bitmap:
    """Kept prefixes of one length, by hash."""

    def __init__(self, length: int, bits: int, words: np.ndarray) -> None:
        self.length, self.mask, self.words = length, np.uint64(bits - 1), words

    def holds(self, keys: np.ndarray) -> np.ndarray:
        at = keys & self.mask
        return self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1) > 0


def _count_prefixes(length: int, before):
    """``(key, docs, goes_on)`` of the prefixes of one length whose shorter prefix was kept, summed over many texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, kept, gathered, long = Powers(), before.value if before else None, [], []

        def summed(parts: list) -> pa.RecordBatch:
            keys, docs, on = sums_by_key(*map(np.concatenate, zip(*parts)))
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(docs), pa.array(on > 0)], names=["key", "docs", "goes_on"])

        def distinct(keys: np.ndarray, on: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
            order = np.argsort(keys, kind="stable")
            keys, on, doc = keys[order], on[order], doc[order]
            new = np.ones(len(keys), dtype=bool)
            new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
            return sums_by_key(keys[new], np.ones(int(new.sum()), dtype=np.int64), on[new].astype(np.int64))

        def whole(parts: list) -> tuple[np.ndarray, ...]:
            """The parts of one long text: it is one document."""
            keys, _, on = map(np.concatenate, zip(*parts))
            return distinct(keys, on > 0, np.zeros(len(keys), dtype=np.int64))

        last = None
        for batch, texts, part in _texts(batches, PIECE_BYTES):
            if long and batch is not last:
                gathered.append(whole(long))
                long = []
            last, terms = batch, Terms(texts, powers)
            salts = _salts(batch.column("lang").to_pylist())
            keys, on = terms.keys(length, salts)
            doc = terms.doc
            if kept is not None:
                shorter, goes_on = terms.keys(kept.length, salts)
                chosen = goes_on & kept.holds(shorter)
                keys, on, doc = keys[chosen], on[chosen], doc[chosen]
            (long if part else gathered).append(distinct(keys, on, doc))
            if sum(len(x[0]) for x in gathered) > GATHERED:
                yield summed(gathered)
                gathered = []
        gathered += [whole(long)] if long else []
        if gathered:
            yield summed(gathered)

    return run


def kept_prefixes(docs: DataFrame, least: int = LEAST) -> list[Bitmap]:
    """The bitmaps of all passes."""
    spark, found, length, before = docs.sparkSession, [], FIRST_LENGTH, None
    while True:
        counts = docs.select("text", "lang").mapInArrow(_count_prefixes(length, before), "key long, docs long, goes_on boolean")
        kept = counts.groupBy("key").agg(F.sum("docs").alias("docs"), F.bool_or("goes_on").alias("goes_on")).where(F.col("docs") >= least)
        kept = stored(kept.select("key", "goes_on"), "divergence-prefixes")
        facts = kept.agg(F.count("*").alias("n"), F.coalesce(F.bool_or("goes_on"), F.lit(False)).alias("goes_on")).first()
        bits = min(MOST_BITS, max(1 << 16, 1 << (16 * facts["n"]).bit_length()))
        at = F.shiftrightunsigned(F.col("key").bitwiseAND(F.lit(bits - 1)), 6).alias("word")
        bit = F.expr("shiftleft(1L, cast(key & 63 as int))")
        words = np.zeros(bits >> 6, dtype=np.uint64)
        rows = kept.groupBy(at).agg(F.bit_or(bit).alias("bits")).toArrow()  # at most MOST_BITS / 64 rows
        words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
        discard(kept)
        found.append(Bitmap(length, bits, words))
        if not facts["goes_on"]:
            return found
        before, length = spark.sparkContext.broadcast(found[-1]), 2 * length


class Gathered:
    """Counts by group and term in a task: groups and terms have numbers, and a number of both is a key."""

    def __init__(self) -> None:
        self.terms: dict[bytes, int] = {}
        self.groups: dict[tuple[str, str], int] = {}
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.rows = 0

    def add(self, *part: np.ndarray) -> None:
        self.parts.append(part)
        self.rows += len(part[0])

    def numbers(self, known: dict, values: list) -> np.ndarray:
        return np.array([known.setdefault(x, len(known)) for x in values], dtype=np.int64)

    def shrink(self) -> None:
        self.parts = [sums_by_key(*map(np.concatenate, zip(*self.parts)))]
        self.rows = len(self.parts[0][0])

    def batches(self) -> Iterator[pa.RecordBatch]:
        """All counts, in pieces; then it is empty."""
        if self.parts:
            self.shrink()
            terms, langs, sources = pa.array(self.terms, pa.binary()), *(pa.array(x, pa.string()) for x in zip(*self.groups))
            for i in range(0, self.rows, 1 << 16):
                key, n, docs = (x[i : i + (1 << 16)] for x in self.parts[0])
                group = pa.array(key >> 32)
                columns = [langs.take(group), sources.take(group), terms.take(pa.array(key & 0xFFFFFFFF)).cast(pa.string()), pa.array(n), pa.array(docs)]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
        self.__init__()


def _count_terms(bitmaps):
    """``(lang, source, term, n, docs)`` of complete kept terms, summed over many texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, levels, gathered, long, last = Powers(), bitmaps.value, Gathered(), [], None

        def counted(batch: pa.RecordBatch, texts: list[bytes]) -> tuple[np.ndarray, ...]:
            langs = batch.column("lang").to_pylist()
            terms, salts = Terms(texts, powers), _salts(langs)
            chosen, size = np.zeros(len(terms.start), dtype=bool), terms.end - terms.start
            for i, level in enumerate(levels):
                here = (size < level.length) & (size >= (levels[i - 1].length if i else 0))
                chosen |= here & level.holds(terms.keys(level.length, salts)[0])
            chosen = np.flatnonzero(chosen)
            coded = terms.take(chosen).dictionary_encode()
            term = gathered.numbers(gathered.terms, coded.dictionary.to_pylist())[coded.indices.to_numpy()]
            group = gathered.numbers(gathered.groups, list(zip(langs, batch.column("source").to_pylist())))
            doc = terms.doc[chosen]
            key = group[doc] << 32 | term
            order = np.argsort(key, kind="stable")
            key, doc = key[order], doc[order]
            new = np.ones(len(key), dtype=np.int64)
            new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            return sums_by_key(key, np.ones(len(key), dtype=np.int64), new)

        def whole(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
            """The parts of one long text: it is one document."""
            key, n, _ = sums_by_key(*map(np.concatenate, zip(*parts)))
            return key, n, np.ones(len(key), dtype=np.int64)

        for batch, texts, part in _texts(batches, PIECE_BYTES):
            if batch is not last:
                if long:
                    gathered.add(*whole(long))
                    long = []
                if gathered.rows > 2 * GATHERED:
                    gathered.shrink()
                if gathered.rows > GATHERED or len(gathered.terms) > GATHERED:
                    yield from gathered.batches()
            last = batch
            if part:
                long.append(counted(batch, texts))
            else:
                gathered.add(*counted(batch, texts))
        if long:
            gathered.add(*whole(long))
        yield from gathered.batches()

    return run


def group_terms(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``(lang, source, term, n, total)``: each group's count of each kept term that it has, and the language's."""
    bitmaps = docs.sparkSession.sparkContext.broadcast(kept_prefixes(docs, least))  # MOST_BITS each at most
    counts = docs.select("lang", "source", "text").mapInArrow(_count_terms(bitmaps), "lang string, source string, term string, n long, docs long")
    counts = stored(counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least)
    kept = stored(kept.select("lang", "term", "total"), "divergence-kept")
    out = stored(join_small(counts.drop("docs"), kept, ["lang", "term"]), "divergence-terms")
    discard(counts, kept)
    return out


def probability(n: Column, total: Column) -> Column:
    """``1 + floor(SCALE * (n + 2) / total)``, exactly."""
    up = (n + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", up, total.cast("decimal(20,0)"))


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def described_groups(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``(lang, source, number, size, lang_size, kept, sources)`` of every group: its number among its language's, the denominators of its and its
    language's probabilities, and how many terms and sources the language has."""
    own = terms.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    kept = terms.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("all"))
    groups = docs.groupBy("lang", "source").agg(F.lit(1).alias("one")).drop("one")
    groups = groups.join(own, ["lang", "source"], "left").join(kept, "lang", "left").fillna(0, ["own", "kept", "all"])
    by_lang = Window.partitionBy("lang")  # its rows are as many as a language has sources, whose pairs are the result
    number = (F.row_number().over(by_lang.orderBy("source")) - 1).alias("number")
    return groups.select("lang", "source", number, (F.col("own") + 2 * F.col("kept")).alias("size"), (F.col("all") + 2 * F.col("kept")).alias("lang_size"), "kept", F.count("*").over(by_lang).alias("sources"))


def _block_sums(key: tuple, t: pa.Table) -> pa.Table:
    """Sums of divergences of each pair of the block's sources over its terms. Rows without a term give each source's least probability."""
    number, p = t.column("number").to_numpy().astype(np.int64), t.column("p").to_numpy().astype(np.int64)
    facts = t.column("term").is_null().to_numpy(zero_copy_only=False)
    order = np.argsort(number[facts])
    sources = number[facts][order]
    coded = t.column("term").combine_chunks().filter(pa.array(~facts)).dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    size = len(coded.dictionary)
    m = np.repeat(p[facts][order][:, None], size, axis=1)
    m[np.searchsorted(sources, number[~facts]), coded.indices.to_numpy()] = p[~facts]
    left, right, value = [], [], []
    a, b = key[1].as_py(), key[2].as_py()
    for i in np.flatnonzero(sources // SOURCES == a).tolist():
        j = np.flatnonzero((sources // SOURCES == b) & (sources > sources[i]))
        if len(j):
            d = m[j] - m[i]
            value.append((d * d // (m[j] + m[i])).sum(axis=1))
            left.append(np.full(len(j), sources[i]))
            right.append(sources[j])
    join = lambda x: np.concatenate(x) if x else np.zeros(0, dtype=np.int64)
    n = len(join(left))
    return pa.table({"lang": pa.array([key[0].as_py()] * n, pa.string()), "a": join(left), "b": join(right), "value": join(value), "seen": np.full(n, size, dtype=np.int64)})


def pair_values(groups: DataFrame, terms: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` of all ordered pairs of a language's sources."""
    least = probability(F.lit(0), F.col("size"))
    facts = join_small(terms, groups, ["lang", "source"]).select("lang", "kept", "sources", "number", "term", probability(F.col("n"), F.col("size")).alias("p"), F.expr(f"array(pmod(xxhash64(term), kept div {TERMS} + 1))").alias("buckets"))
    own = groups.where("kept > 0").select("lang", "kept", "sources", "number", F.lit(None).cast("string").alias("term"), least.alias("p"), F.expr(f"sequence(0L, kept div {TERMS})").alias("buckets"))
    rows = facts.unionByName(own).withColumn("bucket", F.explode("buckets")).withColumn("block", F.expr(f"number div {SOURCES}"))
    rows = rows.withColumn("o", F.explode(F.expr(f"sequence(0L, (sources - 1) div {SOURCES})")))
    rows = rows.select("lang", F.least("block", "o").alias("x"), F.greatest("block", "o").alias("y"), "bucket", "number", "term", "p")
    sums = rows.groupBy("lang", "x", "y", "bucket").applyInArrow(_block_sums, "lang string, a long, b long, value long, seen long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    side = groups.select("lang", "source", "number", "kept", F.when(F.col("kept") > 0, least).alias("p"))
    other = side.select("lang", F.col("source").alias("item"), F.col("number").alias("other"), F.col("p").alias("q"))
    pairs = side.join(other, "lang").where("number <> other").withColumn("a", F.least("number", "other").cast("long")).withColumn("b", F.greatest("number", "other").cast("long"))
    rest = (F.col("kept") - F.coalesce("seen", F.lit(0))) * divergence(F.col("p"), F.col("q"))  # terms that neither has
    value = F.coalesce(F.col("value") + rest, rest, F.lit(0))
    return pairs.join(sums, ["lang", "a", "b"], "left").select("lang", "source", "item", value.cast("long").alias("value"))


def term_values(groups: DataFrame, terms: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` of the terms that a group has more of than its language."""
    df = join_small(terms, groups, ["lang", "source"])
    df = df.select("lang", "source", F.col("term").alias("item"), probability(F.col("n"), F.col("size")).alias("p"), probability(F.col("total"), F.col("lang_size")).alias("q"))
    return df.where("p > q").select("lang", "source", "item", divergence(F.col("p"), F.col("q")).alias("value"))


def source_divergence(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``lang, source, part, item, value, rank`` of every group: its language's other sources, and its ``MOST_TERMS`` most telling terms."""
    docs = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    terms = group_terms(docs, least)
    groups = stored(described_groups(docs.select("lang", "source"), terms), "divergence-groups")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = pair_values(groups, terms).select("*", F.lit("pair").alias("part"), rank)
    best = term_values(groups, terms).select("*", F.lit("term").alias("part"), rank).where(F.col("rank") <= MOST_TERMS)
    return pairs.select(columns).unionByName(best.select(columns))


_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
SQL = rf"""
with d as (select row_number() over () as doc, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
o as (select doc, lang, source, unnest(regexp_extract_all(translate(text, {_LETTERS}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
c as (select lang, source, term, count(*) as n, count(distinct doc) as docs from o group by all),
k as (select lang, term, sum(n) as total from c group by all having sum(docs) >= {LEAST}),
v as (select lang, count(*) as kept, sum(total) as n from k group by lang),
s as (select lang, source, sum(n) as n from c semi join k using (lang, term) group by all),
g as (select d.lang, d.source, coalesce(s.n, 0) as n, coalesce(v.kept, 0) as kept, coalesce(v.n, 0) as lang_n from (select distinct lang, source from d) d left join s using (lang, source) left join v using (lang)),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + ({SCALE}::hugeint * (coalesce(c.n, 0) + 2)) // (g.n + 2 * g.kept) as p, 1 + ({SCALE}::hugeint * (k.total + 2)) // (g.lang_n + 2 * g.kept) as q
    from g join k using (lang) left join c using (lang, source, term)),
f as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value from p a join p b on b.lang = a.lang and b.term = a.term and b.source <> a.source group by all),
x as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0)::bigint as value from g a join g b on b.lang = a.lang and b.source <> a.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
    union all select lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::bigint from p where n > 0 and p > q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from x)
select * from r where part = 'pair' or rank <= {MOST_TERMS}"""
