"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters, verified once per pair.

Documents with equal shingle sets are one class, so copies never make pairs. Each class puts the rarest part of its set, in which any partner
must share a shingle, into a table. The classes of one prefix shingle meet within a task, which applies the length, positional and suffix filters to
whole columns of pairs and hands on only the pairs that pass all three; each such pair is verified once.

What meets at a prefix shingle is narrowed before it moves: of equal texts one row takes part (the others' keys are sent to the tasks), and a class goes only
to shingles where another class has a size that could link (sizes fall in 64 bands; a shingle's bands are one number).

Groups of more than ``FEW`` classes are joined in rounds first: in each such prefix shingle's group one class leads, and every other class of another part is verified
with leaders of shared prefix shingles; classes that link become one part. In the first round the leaders' order is the same in all groups and a class is verified with
the one of most shared shingles, so a family of copies falls into few parts; in later rounds each group has an order of its own, so that a class beside a family's large
part is verified with up to ``TRIES`` members of it. A round costs at most so many pairs a class. Then all pairs of different parts are compared, in blocks of bounded
size where a shingle has many classes, together with all pairs of the small groups, of which those of one part go before they are verified. Links within a part change
nothing, links between parts are all found.

The suffix filter divides shingles by hash into ``RANGES`` ranges and keeps, for each set, whether its count in a range is odd (128 bytes). Two sets
differ by at least one shingle in each range where that differs, so a pair with more such ranges than the threshold allows cannot link. That is too
coarse for large sets, so a pair of these is held against sketches first, the same with at least two ranges for each shingle; whole sets move only for pairs that pass.
Where a set has at most half as many shingles as there are ranges, sketches tell no more than the parities that the pair has passed.

Rarity is a count of hash buckets over all documents (``BUCKETS`` of them); any fixed order keeps the filter exact.

Edge cases: null and empty texts have no shingles, link with nothing and are their own component; equal rows fall in one class; a document
with a null ``doc_id`` takes part, and its component's id is the smallest other id, or null if there is none; an empty table gives an empty result;
extra columns are ignored. A class is known by a 64-bit hash of its set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import discard, join_small, small_batches, stored, whole_row
from .words import Powers, Words, chunks, gram_hashes, mixed, slices, utf8

SHINGLE = 5
#: Link: ``100 * intersection >= PERCENT * union``.
PERCENT = 80
BUCKETS = 1 << 17
RANGES = 1024
#: Rounds with leaders before all pairs of different parts are compared, and the leaders that a class is verified with in a round after the first.
ROUNDS, TRIES = 4, 8
#: Classes of one prefix shingle that are compared in one piece.
BLOCK = 4096
#: Classes of one prefix shingle that are compared without rounds before.
FEW = 8
#: Size bands: a set of n shingles is in band log(n / ``BAND_FROM``) / log(``BAND_STEP``), from 0 to 63; sets that link are at most two bands apart.
BAND_FROM, BAND_STEP, BANDS = 8, 1.125, 64
#: Pairs that a task gathers before it hands them on, and classes that it remembers as done.
GATHERED, REMEMBERED = 1 << 19, 200_000
#: Least prefix shingles of its class that a row carries, so that most pairs are handed on at one shingle only.
LEAST = 4
#: Shared prefix shingles (8 bytes each) that are sent to the tasks; more of them are joined by a shuffle.
SHARED_TOKENS = 4_000_000
#: Keys of further copies (8 bytes each) that are sent to the tasks; with more of them, all copies take part, which changes no result.
COPIES = 4_000_000


def shingle_sets(texts: list[bytes], powers: Powers) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (A-Z as a-z)."""
    out: list[np.ndarray] = []
    for _, part in chunks(texts):
        w = Words([x.lower() for x in part])
        h = w.hashes(powers)
        grams = gram_hashes(h, SHINGLE)
        for i in range(w.n_texts):
            a, b = w.first[i], w.first[i + 1]
            if b - a >= SHINGLE:
                out.append(np.unique(grams[a : b - SHINGLE + 1]))
            else:
                out.append(gram_hashes(h[a:b], int(b - a)) if b > a else np.zeros(0, dtype=np.uint64))
    return out


def class_ids(flat: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set, from two sums over differently mixed members; no set is empty."""
    one, two = (np.add.reduceat(mixed(flat, salt), offset[:-1]) for salt in (101, 102))
    return mixed(one ^ mixed(two + np.diff(offset).astype(np.uint64), 103), 104)


def parities(flat: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """For each set, one bit for each of ``RANGES`` hash ranges: is its count there odd? As rows of 64-bit words."""
    n = len(offset) - 1
    row = np.repeat(np.arange(n), np.diff(offset))
    part = (flat >> np.uint64(64 - 10)).astype(np.int64)
    odd = (np.bincount(row * RANGES + part, minlength=n * RANGES) & 1).astype(np.uint8).reshape(n, RANGES)
    return np.packbits(odd, axis=1).view(np.uint64)


def bands(sizes: np.ndarray) -> np.ndarray:
    """The size band of sets of these sizes (1 at least)."""
    return np.clip(np.floor(np.log(sizes / BAND_FROM) / np.log(BAND_STEP)), 0, BANDS - 1).astype(np.int64)


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])])


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with class and size; at the end, the task's bucket counts as rows without a key."""
    powers, counts = Powers(), np.zeros(BUCKETS, dtype=np.int64)
    names = ["doc_id", "key", "n", "class", "bucket"]
    for batch in slices(batches):
        sets = shingle_sets(utf8(batch.column("text")), powers)
        sizes = np.array([len(x) for x in sets], dtype=np.int64)
        ids, full = np.zeros(len(sets), dtype=np.int64), np.flatnonzero(sizes)
        if len(full):
            flat, offset = _flat([sets[i] for i in full])
            counts += np.bincount((flat % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
            ids[full] = class_ids(flat, offset).view(np.int64)
        none = pa.nulls(len(sets), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(sizes), pa.array(ids), none], names=names)
    used = np.flatnonzero(counts)
    none = pa.nulls(len(used), pa.int64())
    yield pa.RecordBatch.from_arrays([none, none, pa.array(counts[used]), none, pa.array(used)], names=names)


def _new_sets(batch: pa.RecordBatch, powers: Powers, done: set[int]) -> tuple[list[int], list[np.ndarray]]:
    """Classes and sets of the batch's texts that are not in ``done``, which forgets everything when it is full."""
    sets = [x for x in shingle_sets(utf8(batch.column("text")), powers) if len(x)]
    ids = class_ids(*_flat(sets)).view(np.int64).tolist() if sets else []
    if len(done) > REMEMBERED:
        done.clear()
    new = [(c, s) for c, s in zip(ids, sets) if c not in done and not done.add(c)]
    return [c for c, _ in new], [s for _, s in new]


def _without(batch: pa.RecordBatch, keys: np.ndarray) -> pa.RecordBatch:
    """The rows whose key is not in the sorted array ``keys``."""
    if not len(keys):
        return batch
    own = batch.column("key").to_numpy()
    return batch.filter(pa.array(keys[np.minimum(np.searchsorted(keys, own), len(keys) - 1)] != own))


def _prefixes(rarity, copies, wanted=None, full: bool = False):
    """Prefix shingles of each class that the task meets, with the class's size band as a bit. Where the sorted array of shingles in ``wanted`` is given, only
    those in it whose bands have the class's. With ``wanted`` or ``full`` rows have size, place, band, blocks (0 with ``full``) and, as ``marks``, the parities
    and the class's ``LEAST`` least shingles instead. Rows with a key in ``copies`` take no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, count, done = Powers(), rarity.value, set()
        only, only_bands, only_blocks = (None, None, None) if wanted is None else wanted.value
        for batch in slices(batches):
            ids, sets = _new_sets(_without(batch, copies.value), powers, done)
            if not sets:
                continue
            marks = parities(*_flat(sets)) if full or only is not None else None
            band = bands(np.array([len(s) for s in sets]))
            bit = np.uint64(1) << band.astype(np.uint64)
            tokens, classes, sizes, places, rows, blocks, least = [], [], [], [], [], [], np.full((len(sets), LEAST), np.iinfo(np.int64).max)
            for k, (c, s) in enumerate(zip(ids, sets)):
                n = len(s)
                keep = n - (PERCENT * n + 99) // 100 + 1
                order = np.lexsort((s, count[(s % np.uint64(BUCKETS)).astype(np.int64)]))[:keep]
                token, place = s[order].view(np.int64), np.arange(keep, dtype=np.int32)
                if only is not None:
                    at = np.minimum(np.searchsorted(only, token), max(len(only) - 1, 0))
                    hit = (only[at] == token) & (only_bands[at] & bit[k] != 0) if len(only) else np.zeros(keep, dtype=bool)
                    token, place = token[hit], place[hit]
                    blocks.append(only_blocks[at[hit]] if len(only) else np.zeros(0, dtype=np.int32))
                least[k, : min(LEAST, len(token))] = np.sort(token)[:LEAST]
                tokens.append(token)
                classes.append(np.full(len(token), c, dtype=np.int64))
                sizes.append(np.full(len(token), n, dtype=np.int32))
                places.append(place)
                rows.append(np.full(len(token), k))
            token, row = np.concatenate(tokens), np.concatenate(rows)
            if marks is None:
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(bit[row].view(np.int64))], names=["token", "bands"])
                continue
            both, width = np.concatenate([marks, least.view(np.uint64)], axis=1), RANGES // 8 + 8 * LEAST
            raw = both[row].tobytes()
            packed = pa.array([raw[i : i + width] for i in range(0, len(raw), width)], pa.binary())
            block = np.concatenate(blocks) if blocks else np.zeros(len(token), dtype=np.int32)
            columns = [token, *(np.concatenate(x) for x in (classes, sizes, places)), band[row].astype(np.int32), block]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), packed], names=["token", "class", "n", "place", "band", "blocks", "marks"])

    return run


def sketch(members: np.ndarray) -> bytes:
    """The set's size, and for each of at least twice as many hash ranges (a power of two) one bit: is its count there odd?"""
    bits = max(RANGES.bit_length() - 1, (2 * len(members) - 1).bit_length())
    odd = np.bincount((members >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1
    return len(members).to_bytes(8, "little") + np.packbits(odd.astype(np.uint8)).tobytes()


def sketches_may_link(x: bytes, y: bytes) -> bool:
    """The suffix filter on sketches; neighbouring ranges of the finer one are put together."""
    total = sum(int.from_bytes(z[:8], "little") for z in (x, y))
    coarse, fine = sorted((np.unpackbits(np.frombuffer(z, dtype=np.uint8, offset=8)) for z in (x, y)), key=len)
    while len(fine) > len(coarse):
        fine = fine[::2] ^ fine[1::2]
    return int(np.count_nonzero(coarse ^ fine)) * (100 + PERCENT) <= total * (100 - PERCENT)


def _members_of(form):
    """Classes, each with its set in the given form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, done = Powers(), set()
        for batch in slices(batches):
            ids, sets = _new_sets(batch, powers, done)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(map(form, sets), pa.binary())], names=["class", "members"])

    return run


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct numbers."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = len(y) - 1
    return int((y[at] == x).sum())


def may_link(x: np.ndarray, y: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Suffix filter on rows of parities and the sums of both sizes: what the sets differ by at least must not exceed what the threshold allows."""
    least = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    # |x ^ y| = |x| + |y| - 2 * overlap, and overlap >= PERCENT / (100 + PERCENT) * (|x| + |y|).
    return least * (100 + PERCENT) <= total * (100 - PERCENT)


def passing(t: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of rows (i, j) of one prefix shingle those that pass the length, positional and suffix filters."""
    m, n, p, q = t["n"][i], t["n"][j], t["place"][i], t["place"][j]
    most = np.minimum(p, q) + np.minimum(m - p, n - q)
    keep = (100 * np.minimum(m, n) >= PERCENT * np.maximum(m, n)) & (most * (100 + PERCENT) >= PERCENT * (m + n))
    i, j = i[keep], j[keep]
    keep = may_link(t["marks"][i], t["marks"][j], t["n"][i] + t["n"][j])
    return i[keep], j[keep]


def large_sets(t: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of which pairs of rows the sketches are finer than the parities: both sets have more than half as many shingles as there are ``RANGES``."""
    return np.minimum(t["n"][i], t["n"][j]) > RANGES // 2


def _pair_columns(pairs: np.ndarray) -> list[pa.Array]:
    return [pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(pairs[:, 2] > 0)]


def _ends(*keys: np.ndarray) -> np.ndarray:
    """For each row the end of its run of equal keys."""
    size = len(keys[0])
    new = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
    return np.repeat(np.append(new[1:], size), np.diff(np.append(new, size)))


def group_pairs(t: dict[str, np.ndarray]) -> np.ndarray:
    """Pairs of classes (columns a < b, and whether both sets are large) of different parts in whole groups (token, p, q), sorted, parts in order, that pass
    all filters. A step compares every row with the one ``k`` places after its part's last one, in all groups at once."""
    groups = t["token"], t["p"], t["q"]
    end, after = _ends(*groups), _ends(*groups, t["part"])
    rows, out, k = np.arange(len(end)), [], 0
    while len(rows := rows[end[rows] > after[rows] + k]):
        i, j = rows, after[rows] + k
        keep = (t["p"][i] == t["q"][i]) | (t["block"][i] != t["block"][j])
        i, j = passing(t, i[keep], j[keep])
        # A pair that shares a lesser shingle, as far as the rows can tell, is handed on there.
        x, y = t["least"][i][:, :, None], t["least"][j][:, None]
        keep = ~((x == y) & (x < t["token"][i][:, None, None])).any(axis=(1, 2))
        i, j = i[keep], j[keep]
        a, b = t["class"][i], t["class"][j]
        out.append(np.stack([np.minimum(a, b), np.maximum(a, b), large_sets(t, i, j)], axis=1))
        k += 1
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), dtype=np.int64)


def _columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    t = {c: batch.column(c).to_numpy().astype(np.int64) for c in batch.schema.names if c != "marks"}
    both = np.frombuffer(b"".join(batch.column("marks").to_pylist()), dtype=np.uint64).reshape(-1, RANGES // 64 + LEAST)
    t["marks"], t["least"] = both[:, : RANGES // 64], both[:, RANGES // 64 :].view(np.int64)
    return t


def _with_leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups (token, block), sorted, the leader first: pairs of a class and a leader of another part that pass all filters, with the shingles they share here.
    Only a group's leader is kept."""

    def pairs(found: list[np.ndarray]) -> pa.RecordBatch:
        both, n = np.unique(np.concatenate(found), axis=0, return_counts=True)
        return pa.RecordBatch.from_arrays([*_pair_columns(both), pa.array(n)], names=["class", "leader", "large", "n"])

    leader, found = None, []
    for batch in slices(batches, 1 << 14):
        t = _columns(batch)
        if leader is not None:
            t = {c: np.concatenate([leader[c], t[c]]) for c in t}
        end = _ends(t["token"], t["block"])
        first = np.concatenate([[0], end[:-1][end[:-1] != end[1:]]])
        first = np.repeat(first, np.diff(np.append(first, len(end))))
        leader = {c: x[first[-1] : first[-1] + 1] for c, x in t.items()}
        i = np.flatnonzero(t["part"] != t["part"][first])
        i, j = passing(t, i, first[i])
        found.append(np.stack([t["class"][i], t["class"][j], large_sets(t, i, j)], axis=1))
        if sum(map(len, found)) > GATHERED:
            yield pairs(found)
            found = []
    if found:
        yield pairs(found)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole groups (token, p, q), sorted. Only groups that may still go on are kept."""

    def pairs(found: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(_pair_columns(np.unique(np.concatenate(found), axis=0)), names=["a", "b", "large"])

    left, found = None, []
    for batch in slices(batches, 1 << 14):
        t = _columns(batch)
        if left is not None:
            t = {c: np.concatenate([left[c], t[c]]) for c in t}
        last = np.flatnonzero((t["token"] != t["token"][-1]) | (t["p"] != t["p"][-1]) | (t["q"] != t["q"][-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        left = {c: x[cut:] for c, x in t.items()}
        if cut:
            found.append(group_pairs({c: x[:cut] for c, x in t.items()}))
        if sum(map(len, found)) > GATHERED:
            yield pairs(found)
            found = []
    if left is not None and len(left["token"]):
        found.append(group_pairs(left))
    if found:
        yield pairs(found)


def sets_link(x: bytes, y: bytes) -> bool:
    x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
    both = overlap(x, y)
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def _passing(test):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            mask = pa.array(list(map(test, batch.column("x").to_pylist(), batch.column("y").to_pylist())), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return run


def compared(pairs: DataFrame, docs: DataFrame, classes: DataFrame, form, test) -> DataFrame:
    """The pairs ``(a, b)`` of classes whose sets in this form pass the test; only their documents' sets are moved. ``pairs`` go."""
    members = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    wanted = stored(members.join(classes.select("class", "key"), "class").select("key"), "jaccard-wanted")
    sets = join_small(docs, wanted, ["key"], "left_semi").select("text").mapInArrow(_members_of(form), "class long, members binary")
    sets = stored(sets.dropDuplicates(["class"]), "jaccard-sets")
    x, y = sets.toDF("a", "x").hint("shuffle_merge"), sets.toDF("b", "y").hint("shuffle_merge")
    passed = stored(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_passing(test), "a long, b long"), "jaccard-passed")
    discard(pairs, wanted, sets)
    return passed


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of the pairs ``(a, b, large)`` of classes the ``(a, b)`` that link, each compared once. Only pairs of ``large`` sets have sketches that tell more than
    the parities, which all of them have passed."""
    pairs = stored(pairs, "jaccard-pairs")
    large = stored(pairs.where("large").select("a", "b"), "jaccard-large")
    close, small = large if large.isEmpty() else compared(large, docs, classes, sketch, sketches_may_link), pairs.where("not large").select("a", "b")
    links = compared(stored(small.unionByName(close), "jaccard-close"), docs, classes, np.ndarray.tobytes, sets_link)
    discard(pairs, close)
    return links


def prefixes(docs: DataFrame, rarity, copies=None) -> DataFrame:
    """``(token, class, n, place, marks, block, blocks)`` of the prefix shingles where a class may have a partner by size; ``copies`` has the keys of rows that need
    not take part, sorted. ``blocks`` is 0 for a shingle of at most ``FEW`` classes; one of many classes has several, a power of two."""
    send, docs = docs.sparkSession.sparkContext.broadcast, docs.select("key", "text")
    copies = send(np.zeros(0, dtype=np.int64) if copies is None else copies)
    counts = docs.mapInArrow(_prefixes(rarity, copies), "token long, bands long").groupBy("token").agg(F.count("*").alias("n"), F.bit_or("bands").alias("bands"))
    # As many classes as bands: each is alone in its band and needs one of the next two.
    near = "bands & (shiftleft(bands, 1) | shiftleft(bands, 2) | shiftrightunsigned(bands, 1) | shiftrightunsigned(bands, 2))"
    blocks = F.expr(f"cast(if(n > {BLOCK}, power(2, ceil(log2(n / {BLOCK // 2}))), if(n > {FEW}, 1, 0)) as int)")
    shared = counts.where("n > 1").select("token", F.expr(f"if(n > bit_count(bands), bands, {near})").alias("bands"), blocks.alias("blocks"))
    shared = stored(shared.where("bands <> 0"), "jaccard-tokens")
    schema = "token long, class long, n int, place int, band int, blocks int, marks binary"
    if shared.count() <= SHARED_TOKENS:
        found = shared.toArrow().sort_by("token")
        wanted = send((found.column("token").to_numpy(), found.column("bands").to_numpy().view(np.uint64), found.column("blocks").to_numpy()))
        rows = docs.mapInArrow(_prefixes(rarity, copies, wanted), schema)
    else:
        rows = docs.mapInArrow(_prefixes(rarity, copies, None, True), schema).drop("blocks").join(shared, "token").where("getbit(bands, band) = 1")
    return rows.drop("band", "bands").withColumn("block", F.expr("cast(pmod(xxhash64(class), greatest(blocks, 1)) as int)"))


def leader_pairs(rows: DataFrame, number: int) -> DataFrame:
    """Pairs ``(a, b, large)`` of a class and its leader of most shared shingles in the first round, its ``TRIES`` leaders of most in a later one. In the first
    the order of leaders is the same in all groups, so that a family has few of them. Later ones have an order of classes in each group: most groups of a
    family are then led by its largest part, each by another member, so that who stands beside that part meets many of it, and it meets nobody."""
    order = F.xxhash64("part", F.lit(number)) if number == 0 else F.xxhash64("class", "token", F.lit(number))
    met = rows.select("token", "block", "class", "part", "n", "place", "marks").repartition("token", "block").sortWithinPartitions("token", "block", order, "class")
    met = met.mapInArrow(_with_leaders, "class long, leader long, large boolean, n long").groupBy("class", "leader", "large").agg(F.sum("n").alias("n"))
    # A class has fewer leaders than prefix shingles.
    best = F.slice(F.sort_array(F.collect_list(F.struct("n", "leader", "large")), asc=False), 1, TRIES if number else 1)
    met = met.groupBy("class").agg(best.alias("best")).select("class", F.inline("best").alias("n", "leader", "large"))
    return met.select(F.least("class", "leader").alias("a"), F.greatest("class", "leader").alias("b"), "large").distinct()


def block_pairs(rows: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``rows`` with the pairs ``(p, q)`` of blocks that each one goes to, and the tables that this reads.

    Shingles of at most ``BLOCK`` classes are one block. Of the others, those of one part go. A large part has blocks of its own, which never meet each
    other; parts of up to half a block share blocks. So a settled family with few other rows is sent about as often as those others have blocks."""
    half, columns = BLOCK // 2, ["token", "class", "part", "n", "place", "marks", "block", "p", "q"]
    few = rows.where("blocks = 1").withColumn("p", F.lit(0)).withColumn("q", F.lit(0))
    rows = rows.where("blocks > 1").drop("block", "blocks")
    sizes = stored(rows.groupBy("token", "part").count(), "jaccard-sizes")
    own = F.expr(f"if(count > {half}, cast(ceil(count / {half}) as int), 0)")
    total = sizes.groupBy("token").agg(F.count("*").alias("parts"), F.expr(f"cast(ceil(sum(if(count > {half}, 0, count)) / {half}) as int)").alias("shared"), F.sum(own).cast("int").alias("large"))
    total = stored(total.where("parts > 1").drop("parts"), "jaccard-many")
    first = F.sum("own").over(Window.partitionBy("token").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    large = stored(sizes.where(f"count > {half}").select("token", "part", own.alias("own")).withColumn("first", F.coalesce(first, F.lit(0)).cast("int")), "jaccard-large")
    many = join_small(join_small(rows, total, ["token"]), large, ["token", "part"], "left")
    many = many.withColumn("block", F.expr("cast(if(own is null, pmod(xxhash64(part), shared), shared + first + pmod(xxhash64(class), own)) as int)"))
    others = "filter(sequence(0, shared + large - 1), o -> own is null or o < shared + first or o >= shared + first + own)"
    many = many.withColumn("pq", F.explode(F.expr(f"transform({others}, o -> struct(least(o, block) as p, greatest(o, block) as q))")))
    many = many.withColumn("p", F.col("pq.p")).withColumn("q", F.col("pq.q"))
    return few.select(columns).unionByName(many.select(columns)), [sizes, total, large]


def prefix_pairs(rows: DataFrame, few: DataFrame, parts: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs of classes of different parts that share a prefix shingle and pass all filters, and the tables that this reads. The rows of small groups, ``few``,
    need no part: a part's own pairs go afterwards."""
    rows, read = block_pairs(rows)
    few = few.select("token", "class", F.col("class").alias("part"), "n", "place", "marks", "block", F.lit(0).alias("p"), F.lit(0).alias("q"))
    met = rows.unionByName(few).repartition("token", "p", "q").sortWithinPartitions("token", "p", "q", "part")
    pairs = stored(met.mapInArrow(_meet, "a long, b long, large boolean").distinct(), "jaccard-met")
    return of_parts(pairs, parts).where("pa <> pb").select("a", "b", "large"), [*read, pairs]


def of_parts(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of classes with their parts ``pa`` and ``pb``."""
    at = lambda c: parts.toDF(c, f"p{c}")
    return join_small(join_small(pairs, at("a"), ["a"]), at("b"), ["b"])


def merged(parts: DataFrame, links: DataFrame) -> DataFrame:
    """``parts`` after those of linked classes became one; ``parts`` and ``links`` go."""
    roots = components(of_parts(links, parts).select(F.col("pa").alias("a"), F.col("pb").alias("b")))
    moved = join_small(parts, roots.toDF("part", "root"), ["part"], "left").select("class", F.coalesce("root", "part").alias("part"))
    moved = stored(moved, "jaccard-parts")
    discard(links, parts, roots)
    return moved


def class_parts(docs: DataFrame, classes: DataFrame, rarity, rounds: int = ROUNDS, copies=None) -> DataFrame:
    """``(class, part)`` of every class that shares a prefix shingle: equal parts, same component."""
    rows = stored(prefixes(docs, rarity, copies), "jaccard-prefixes")
    many = stored(rows.where("blocks > 0"), "jaccard-crowded")
    parts = stored(many.select("class").distinct().withColumn("part", F.col("class")), "jaccard-parts")
    for number in range(0 if parts.isEmpty() else rounds):
        parts = merged(parts, verified(leader_pairs(join_small(many, parts, ["class"]), number), docs, classes))
    every = join_small(rows.select("class").distinct(), parts, ["class"], "left").select("class", F.coalesce("part", "class").alias("part"))
    every = stored(every, "jaccard-parts")
    discard(parts)
    pairs, read = prefix_pairs(join_small(many, every, ["class"]), rows.where("blocks = 0"), every)
    links = verified(pairs, docs, classes)
    discard(rows, many, *read)
    return merged(every, links)


def described(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows as ``(doc_id, key, n, class, bucket)``, and the classes."""
    rows = stored(docs.mapInArrow(_describe, "doc_id long, key long, n long, class long, bucket long"), "jaccard-rows")
    full = rows.where("bucket is null and n > 0")
    classes = full.groupBy("class").agg(F.min("key").alias("key"))
    return rows, stored(classes, "jaccard-classes")


def further_copies(rows: DataFrame, classes: DataFrame) -> np.ndarray | None:
    """Sorted keys of the rows beside the one by which their class is known; None if they are more than ``COPIES``."""
    first = classes.select("class", F.col("key").alias("first"))
    further = stored(rows.where("bucket is null and n > 0").join(first, "class").where("key <> first").select("key").distinct(), "jaccard-copies")
    keys = np.sort(further.toArrow().column("key").to_numpy()) if further.count() <= COPIES else None
    discard(further)
    return keys


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, key, n, component`` of every row, where ``key`` is ``xxhash64(doc_id, text)`` and ``component`` is null without shingles."""
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    with small_batches(docs.sparkSession):
        rows, classes = described(docs)
        sums = rows.where("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most BUCKETS rows
        count = np.zeros(BUCKETS, dtype=np.int64)
        count[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
        rarity = docs.sparkSession.sparkContext.broadcast(count)
        roots = class_parts(docs, classes, rarity, copies=further_copies(rows, classes)).toDF("class", "root")
    out = rows.where("bucket is null").select("doc_id", "key", "n", "class")
    joined = join_small(out, roots, ["class"], "left")
    return joined.select("doc_id", "key", "n", F.when(F.col("n") > 0, F.coalesce("root", "class")).alias("component"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document."""
    found = stored(near_duplicates(docs), "jaccard-found")
    least = stored(found.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id")), "jaccard-least")
    joined = join_small(found, least, ["component"], "left")
    own = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: the one of the smallest (``doc_id``, text hash); rows without shingles all stay."""
    found = stored(near_duplicates(docs), "jaccard-found")
    first = found.where("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "key"))["key"].alias("key"))
    kept = stored(first.select("key").unionByName(found.where("component is null").select("key").distinct()), "jaccard-kept")
    # The whole row is one column, so no name of the table's own is in the way.
    keyed = docs.select(whole_row(docs).alias("row"), F.xxhash64("doc_id", "text").alias("key"))
    left = join_small(keyed, kept, ["key"])
    # Rows that are equal in id and text have one key; of those with words one stays.
    words = F.coalesce(F.rlike("row.text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    return left.where(words).dropDuplicates(["key"]).unionByName(left.where(~words)).select("row.*")
