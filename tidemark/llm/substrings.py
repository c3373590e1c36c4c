"""Substring dedup: suffix automata of reference shards, and matching statistics of the texts streamed against them.

The reference of a corpus's own repeats is the corpus, whose automaton has no size bound. So passages are first cut at anchors that
depend on content alone: in every window of ``WINDOW`` words the eight-word run of least hash is the window's anchor, and a passage is
the words of consecutive windows with one anchor. Equal windows have equal anchors, so a window can only repeat where its anchor's hash does. Passages whose
anchor is found once are done with. The others, each distinct passage once with its count, are dealt by anchor into shards of bounded size;
each shard's suffix automaton (over word numbers, with occurrence counts) is built in one task, and the shard's passages are streamed
through it: a window is repeated if it matches with at least ``WINDOW`` words at a state of two or more occurrences. An anchor with more
distinct passages than a shard takes is dealt on by context: a window has at least ``_SIDE`` words before its anchor or as many after it, and equal
windows agree in them, so each passage falls into two parts at most. A part that is still too frequent is taken as single windows, which are
summed by their words before they move: each distinct window is one row with its count, and repeated if that is over one.

``reference_spans`` is the operator against a given reference: its shards' automata are broadcast, one bounded shard at a time.

Edge cases: null and empty texts have no words; texts shorter than a window lose nothing; equal rows repeat each other; a null ``doc_id``
takes part; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, join_small, stored
from .words import Powers, Words, chunks, gram_hashes, mixed, slices, utf8

WINDOW = 35
ANCHOR = 8
#: Passages in a shard; each has at most 62 words.
SHARD_PASSAGES = 1000
_SPAN = WINDOW - ANCHOR + 1
_SIDE = _SPAN // 2


def anchors(w: Words, powers: Powers) -> tuple[np.ndarray, ...]:
    """Anchor hash, content digest, first word, number of windows and the anchor's place of each passage of the texts."""
    none = np.zeros(0, dtype=np.int64)
    if len(w) < WINDOW:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    h = w.hashes(powers)
    grams = gram_hashes(h, ANCHOR)
    at = np.arange(len(w) - WINDOW + 1) + np.lib.stride_tricks.sliding_window_view(grams, _SPAN).argmin(axis=1)
    start = np.flatnonzero(w.doc[WINDOW - 1 :] == w.doc[: len(w) - WINDOW + 1])
    if not len(start):
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    chosen, doc = at[start], w.doc[start]
    new = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])]))
    n = np.diff(np.concatenate([new, [len(start)]]))
    first, anchor = start[new], grams[chosen[new]]
    up, down = powers.to(len(w) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(h * up[: len(h)])])
    digest = (sums[first + n + WINDOW - 1] - sums[first]) * down[first]
    return anchor, mixed(digest ^ mixed(n.astype(np.uint64), 7), 8), first, n, chosen[new] - first


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for batch in slices(batches, 2048):
        keys = np.array(batch.column("key").to_pylist(), dtype=np.int64)
        for first, part in chunks(utf8(batch.column("text"))):
            w = Words(part)
            anchor, digest, start, n, place = anchors(w, powers)
            doc = w.doc[start]
            columns = [anchor.view(np.int64), digest.view(np.int64), keys[first + doc], (start - w.first[doc]).astype(np.int32), n.astype(np.int32), place.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["anchor", "digest", "key", "start", "n", "place"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the wanted passages of each document."""
    for batch in slices(batches):
        out: list[tuple] = []
        for text, wanted in zip(utf8(batch.column("text")), batch.column("wanted").to_pylist()):
            words = text.split()
            for x in wanted:
                out.append((x["anchor"], x["digest"], x["count"], x["many"], x["place"], b" ".join(words[x["start"] : x["start"] + x["n"] + WINDOW - 1])))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 6, types)], names=["anchor", "digest", "count", "many", "place", "words"])


class SuffixAutomaton:
    """Suffix automaton of sequences of numbers, with the number of occurrences (by weight) of each state's strings."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def add(self, sequence: list[int], weight: int) -> None:
        following, link, length, count, last = self.next, self.link, self.length, self.count, 0
        for c in sequence:
            if c in following[last]:
                q = following[last][c]
                if length[q] == length[last] + 1:
                    last = q
                else:
                    last = self._clone(q, last, c)
                count[last] += weight
                continue
            cur = len(following)
            following.append({})
            link.append(0)
            length.append(length[last] + 1)
            count.append(weight)
            p = last
            while p >= 0 and c not in following[p]:
                following[p][c] = cur
                p = link[p]
            if p >= 0:
                q = following[p][c]
                link[cur] = q if length[p] + 1 == length[q] else self._clone(q, p, c)
            last = cur

    def _clone(self, q: int, p: int, c: int) -> int:
        new = len(self.next)
        self.next.append(self.next[q].copy())
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.count.append(0)
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def finish(self) -> None:
        """Adds up occurrences along suffix links, longest strings first."""
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[s]] += self.count[s]

    def statistics(self, sequence: list[int], least: int) -> Iterator[tuple[int, int]]:
        """(end, occurrences) for each end at which the ``least`` numbers before it occur."""
        state, matched, following, link, length = 0, 0, self.next, self.link, self.length
        for end, c in enumerate(sequence, 1):
            while state and c not in following[state]:
                state = link[state]
                matched = length[state]
            if c in following[state]:
                state, matched = following[state][c], matched + 1
            else:
                matched = 0
            # The state of the last `least` numbers alone: up the suffix links while its strings are long enough.
            while state and length[link[state]] >= least:
                state = link[state]
                matched = length[state]
            if matched >= least:
                yield end, self.count[state]


def repeated_starts(passages: list[tuple[list[int], int]], window: int = WINDOW) -> list[list[int]]:
    """For each (numbers, weight): the starts of its windows that occur twice or more by weight."""
    automaton = SuffixAutomaton()
    for sequence, weight in passages:
        automaton.add(sequence, weight)
    automaton.finish()
    return [[end - window for end, n in automaton.statistics(sequence, window) if n > 1] for sequence, _ in passages]


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition holds whole shards, sorted by shard; one shard's passages are in memory at a time."""

    def results(rows: list[tuple]) -> pa.RecordBatch:
        number: dict[bytes, int] = {}
        found = repeated_starts([([number.setdefault(x, len(number)) for x in words.split()], weight) for _, _, weight, _, words in rows])
        masks = [sum(1 << (s + at) for s in starts) for starts, (_, _, _, at, _) in zip(found, rows)]
        out = [(a, d, m) for (a, d, _, _, _), m in zip(rows, masks) if m]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out) if out else [[]] * 3)], names=["anchor", "digest", "mask"])

    shard, rows = None, []
    for batch in slices(batches):
        for s, *row in zip(*(batch.column(c).to_pylist() for c in ("shard", "anchor", "digest", "count", "at", "words"))):
            if s != shard and rows:
                yield results(rows)
                rows = []
            shard = s
            rows.append(tuple(row))
    if rows:
        yield results(rows)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each passage as the windows with ``_SIDE`` words before the anchor and the others, dealt by those words or the ones after it."""
    for batch in slices(batches):
        out = []
        for anchor, digest, count, place, passage in zip(*(batch.column(c).to_pylist() for c in ("anchor", "digest", "count", "place", "words"))):
            words = passage.split()
            n = len(words) - WINDOW + 1
            cut = min(n, max(0, place - _SIDE + 1))
            after = place + ANCHOR
            for first, last, context in ((0, cut, words[place - _SIDE : place] if cut else []), (cut, n, words[after : after + _SIDE])):
                if first < last:
                    deal = hashlib.blake2b(b" ".join((b"<" if first < cut else b">", *context)), digest_size=8).digest()
                    out.append((anchor, digest, count, int.from_bytes(deal, "little", signed=True), first, b" ".join(words[first : last + WINDOW - 1])))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 6, types)], names=["anchor", "digest", "count", "deal", "at", "words"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each part of a passage as its single windows."""
    for batch in slices(batches):
        out = []
        for anchor, digest, count, first, passage in zip(*(batch.column(c).to_pylist() for c in ("anchor", "digest", "count", "at", "words"))):
            words = passage.split()
            out += [(anchor, digest, count, first + at, b" ".join(words[at : at + WINDOW])) for at in range(len(words) - WINDOW + 1)]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 5, types)], names=["anchor", "digest", "count", "at", "words"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        n_words, n_removed, kept = [], [], []
        for text, found in zip(utf8(batch.column("text")), batch.column("found").to_pylist()):
            words = text.split()
            gone = np.zeros(len(words) + 1, dtype=np.int64)
            for x in found or []:
                for j in range(x["mask"].bit_length()):
                    if x["mask"] >> j & 1:
                        gone[x["start"] + j] += 1
                        gone[x["start"] + j + WINDOW] -= 1
            if found:
                covered = np.cumsum(gone[:-1]) > 0
                words_kept = [w for w, c in zip(words, covered.tolist()) if not c]
            else:
                words_kept = words
            n_words.append(len(words))
            n_removed.append(len(words) - len(words_kept))
            kept.append(b" ".join(words_kept).decode())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def _window_masks(parts: DataFrame) -> DataFrame:
    """``anchor, digest, mask`` of the repeated windows of crowded parts. Equal windows are summed before they move, so a frequent one is a row
    for each task at most; all windows but those counted once are repeated, so no window's copies have to meet again."""
    windows = parts.mapInArrow(_windows, "anchor long, digest long, count long, at int, words binary")
    once = windows.groupBy("anchor", "words").agg(F.sum("count").alias("n"), F.min("digest").alias("digest"), F.min("at").alias("at")).where("n = 1")
    once = once.select("anchor", "digest", F.lit(0).cast("long").alias("every"), F.expr("shiftleft(1L, at)").alias("once"))
    n = F.size(F.split(F.col("words").cast("string"), " ")) - (WINDOW - 1)
    every = parts.withColumn("n", n).select("anchor", "digest", F.expr("shiftleft(shiftleft(1L, n) - 1, at)").alias("every"), F.lit(0).cast("long").alias("once"))
    both = every.unionByName(once).groupBy("anchor", "digest").agg(F.bit_or("every").alias("every"), F.bit_or("once").alias("once"))
    return both.select("anchor", "digest", F.expr("every & ~once").alias("mask")).where("mask <> 0")


def repeated_passages(docs: DataFrame, shard_passages: int = SHARD_PASSAGES) -> DataFrame:
    """``(key, start, mask)``: bit j of ``mask`` is set if the window that starts at word ``start + j`` of document ``key`` is repeated."""
    all_ = stored(docs.mapInArrow(_passages, "anchor long, digest long, key long, start int, n int, place int"), "substr-anchors")
    often = stored(all_.groupBy("anchor").count().where("count > 1").select("anchor"), "substr-often")
    repeated = stored(join_small(all_, often, ["anchor"]), "substr-repeated")
    discard(all_, often)
    distinct = repeated.groupBy("anchor", "digest").agg(F.count("*").alias("count"), F.min(F.struct("key", "start", "n", "place")).alias("at"))
    distinct = stored(distinct, "substr-distinct")
    many = stored(distinct.groupBy("anchor").count().where(f"count > {shard_passages}").select("anchor", F.lit(True).alias("many")), "substr-many")
    wanted = join_small(distinct, many, ["anchor"], "left")
    wanted = wanted.select("at.key", F.struct("anchor", "digest", "count", F.coalesce("many", F.lit(False)).alias("many"), "at.start", "at.n", "at.place").alias("x"))
    wanted = stored(wanted.groupBy("key").agg(F.collect_list("x").alias("wanted")), "substr-wanted")
    once = docs.join(wanted.hint("shuffle_merge"), "key").select("key", "text", "wanted")
    schema = "anchor long, digest long, count long, many boolean, place int, words binary"
    cut = stored(once.mapInArrow(_cut, schema).dropDuplicates(["anchor", "digest"]), "substr-passages")
    discard(distinct, many, wanted)
    shards = max(1, cut.count() // shard_passages + 1)
    columns = ["anchor", "digest", "count", "at", "words"]
    few = cut.where("not many").withColumn("at", F.lit(0)).select(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"), *columns)
    parts = parts_table = stored(cut.where("many").mapInArrow(_parts, "anchor long, digest long, count long, deal long, at int, words binary"), "substr-parts")
    crowded = stored(parts.groupBy("anchor", "deal").count().where(f"count > {shard_passages}").select("anchor", "deal", F.lit(True).alias("crowded")), "substr-crowded")
    parts = join_small(parts, crowded, ["anchor", "deal"], "left")
    dealt = parts.where("crowded is null").select(F.pmod(F.xxhash64("anchor", "deal"), F.lit(shards)).alias("shard"), *columns)
    windows = _window_masks(parts.where("crowded").select(*columns))
    match = lambda df: df.repartition(shards // 8 + 1, "shard").sortWithinPartitions("shard").mapInArrow(_match, "anchor long, digest long, mask long")
    masks = match(few).unionByName(match(dealt)).unionByName(windows)
    masks = stored(masks.groupBy("anchor", "digest").agg(F.bit_or("mask").alias("mask")), "substr-masks")
    discard(cut, parts_table, crowded)
    out = stored(join_small(repeated, masks, ["anchor", "digest"]).select("key", "start", "mask").distinct(), "substr-windows")
    discard(repeated, masks)
    return out


def without_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` of every row: ``kept`` has the words outside repeated windows, joined by single spaces."""
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    windows = repeated_passages(docs)
    found = stored(windows.groupBy("key").agg(F.collect_list(F.struct("start", "mask")).alias("found")), "substr-found")
    discard(windows)
    joined = docs.join(found.hint("shuffle_merge"), "key", "left").select("doc_id", "text", "found")
    return joined.mapInArrow(_remove, "doc_id long, n_words long, n_removed long, kept string")


def substring_digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every document."""
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def reference_spans(docs: DataFrame, reference: DataFrame, least: int = WINDOW, shard_words: int = 200_000) -> DataFrame:
    """``doc_id, start, end``: spans of words of ``docs`` whose windows of ``least`` words occur in ``reference(text)``.

    The reference is read in shards of about ``shard_words`` words; each shard's automaton is broadcast and all documents are streamed
    past it, so this is for references much smaller than ``docs`` (a benchmark's items)."""
    spark = docs.sparkSession
    sizes = reference.agg(F.sum(F.length("text"))).first()[0] or 0
    n = sizes // (6 * shard_words) + 1
    out = None
    for shard in range(n):
        texts = [r["text"] or "" for r in reference.where(F.pmod(F.xxhash64("text"), F.lit(n)) == shard).select("text").distinct().toLocalIterator()]
        sent = spark.sparkContext.broadcast([x.encode() for x in texts])
        part = docs.select("doc_id", "text").mapInArrow(_spans(sent, least), "doc_id long, start int, end int")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def _spans(sent, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[bytes, int] = {}
        automaton = SuffixAutomaton()
        for text in sent.value:
            automaton.add([number.setdefault(x, len(number)) for x in text.split()], 1)
        automaton.finish()
        for batch in slices(batches):
            out: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text"))):
                open_ = None
                for end, _ in automaton.statistics([number.get(x, -1) for x in text.split()], least):
                    if open_ and end - least <= open_[1]:
                        open_[1] = end
                        continue
                    if open_:
                        out.append((doc_id, *open_))
                    open_ = [end - least, end]
                if open_:
                    out.append((doc_id, *open_))
            types = [pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 3, types)], names=["doc_id", "start", "end"])

    return run


