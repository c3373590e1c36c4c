"""Byte-level BPE by the ranks of a vocabulary file, for words of any length.

A text is cut into the matches of the file's pattern; each match that is a token itself is that token, any other is merged from its bytes, the pair of the
lowest rank first and of equal ones the leftmost. Pairs wait in buckets, one for each rank, that hold the positions where such a pair begins; which buckets
hold something is a bitmap of two levels with words of 256 bits, so the next rank is found by two find-first-set steps however long the word is. Positions are links of a
list of parts; an entry whose pair is no more is stale and skipped when it comes up. Words of n bytes take n log n steps.

Texts are read once and nothing is shuffled: distinct spans of a portion of texts are cut and looked up once, words are remembered within a task, and the words
of a portion that are new go through one queue together.

Edge cases: null and empty texts have no tokens. Repeated rows are encoded alike, each on its own row. Empty tables give empty results. A null ``doc_id`` is
kept. Extra columns are ignored. Texts and words may be of any length.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import Splitter, _binary, _parts, _strings, _words
from .words import portions

MEMO_ENTRIES = 600_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file with their ranks, which are their ids."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class RankBpe:
    """Encodes words by ranks, which are below 256 ** 2. Many words go through one queue: they lie one after the other with a gap between, where no part
    begins, so no pair spans two words; and what a word's pairs are merged into depends on that word alone."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=1)
        self.length = dict(zip(ranks.values(), map(len, ranks)))
        #: The rank of each byte and of each pair of bytes, -1 if it is no token.
        self.byte, self.pair = np.full(256, -1), np.full(1 << 16, -1)
        for token, rank in ranks.items():
            if len(token) == 1:
                self.byte[token[0]] = rank
            elif len(token) == 2:
                self.pair[token[0] << 8 | token[1]] = rank

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        get = self.ranks.get
        whole = list(map(get, words))
        parts = [w for w, x in zip(words, whole) if x is None]
        merged = iter(self._merged(parts) if parts else ())
        return [next(merged) if x is None else x.to_bytes(4, "little") for x in whole]

    def _merged(self, words: list[bytes]) -> list[bytes]:
        get, longest, length = self.ranks.get, self.longest, self.length
        data = b"\0" + b"\0".join(words) + b"\0"
        n, raw = len(data), np.frombuffer(data, dtype=np.uint8).astype(np.int64)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        gap = np.zeros(n, dtype=bool)
        gap[0] = gap[ends] = True
        # The part that begins at i ends at after[i], follows the one that begins at before[i] and is the token tokens[i]; none begins where after is 0.
        after = np.where(gap, 0, np.arange(1, n + 1)).tolist()
        before, tokens = list(range(-1, n - 1)), self.byte[raw].tolist()
        # The queue: positions by rank, a bitmap of the ranks that have any in words of 256, and a bitmap of the words that are not zero.
        first = np.where(gap[:-1] | gap[1:], -1, self.pair[raw[:-1] << 8 | raw[1:]])
        order = np.argsort(first, kind="stable")
        order = order[np.searchsorted(first[order], 0) :]
        known, starts = np.unique(first[order], return_index=True)
        buckets = dict(zip(known.tolist(), [x.tolist() for x in np.split(order, starts[1:])])) if len(known) else {}
        leaf, top = {}, 0
        for rank in buckets:
            leaf[rank >> 8] = leaf.get(rank >> 8, 0) | 1 << (rank & 255)
        for high in leaf:
            top |= 1 << high
        while top:
            high = (top & -top).bit_length() - 1
            bits = leaf[high]
            low = bits & -bits
            rank = high << 8 | low.bit_length() - 1
            leaf[high] = bits = bits ^ low
            if not bits:
                top ^= 1 << high
            size, positions = length[rank], buckets.pop(rank)
            if len(positions) > 1:
                positions.sort()
            for k, i in enumerate(positions):
                j = after[i]
                if not j or after[j] - i != size:
                    continue  # stale: the pair is no more
                end = after[i] = after[j]
                after[j], tokens[i], lowest = 0, rank, rank
                if stop := after[end]:
                    before[end] = i
                    if stop - i <= longest and (r := get(data[i:stop])) is not None:
                        if r in buckets:
                            buckets[r].append(i)
                        else:
                            buckets[r] = [i]
                            leaf[r >> 8] = leaf.get(r >> 8, 0) | 1 << (r & 255)
                            top |= 1 << (r >> 8)
                        if r < lowest:
                            lowest = r
                start = before[i]
                if after[start] and end - start <= longest and (r := get(data[start:end])) is not None:
                    if r in buckets:
                        buckets[r].append(start)
                    else:
                        buckets[r] = [start]
                        leaf[r >> 8] = leaf.get(r >> 8, 0) | 1 << (r & 255)
                        top |= 1 << (r >> 8)
                    if r < lowest:
                        lowest = r
                if lowest < rank:  # a pair of a lower rank has come up: the rest waits
                    if k + 1 < len(positions):
                        buckets[rank] = positions[k + 1 :]
                        leaf[high] |= low
                        top |= 1 << high
                    break
        alive = np.array(after) > 0
        ids = np.array(tokens)[alive].astype("<u4").tobytes()
        cuts = (4 * np.concatenate([[0], np.cumsum(alive)[ends]])).tolist()
        return [ids[x:y] for x, y in zip(cuts, cuts[1:])]


class WordIds(dict):
    """The ids of words as bytes. Forgets everything at ``MEMO_ENTRIES`` words."""

    def __init__(self, bpe: RankBpe, find) -> None:
        super().__init__()
        self.bpe, self.find = bpe, find

    def of_spans(self, spans: list[str]) -> list[bytes]:
        """The ids of spans, each distinct; words not met before are encoded together. A span that is a word met before is that word alone."""
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        found, cut = list(map(self.get, spans)), {}
        for i, x in enumerate(found):
            if x is None:
                cut[i] = _words(spans[i], self.find)
        fresh = list({w for words in cut.values() for w in words if w not in self})
        self.update(zip(fresh, self.bpe.encode_words([w.encode() for w in fresh])))
        get = self.__getitem__
        for i, words in cut.items():
            found[i] = b"".join(map(get, words))
        return found


def _encode(ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter([])
        ids = WordIds(RankBpe(ranks.value), split.find)
        for batch in portions(batches, "text"):
            spans = split.read(batch.column("text"))
            found = pa.array(ids.of_spans(_strings(spans.distinct)), pa.binary())
            offsets, data = _parts(found.take(pa.array(spans.codes)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _binary(offsets[spans.first], data, pa.binary())], names=["doc_id", "ids"])

    return run


def rank_encode(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids)`` of every row: the ids of the whole text as little-endian unsigned 32-bit integers."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))  # as many as the vocabulary file has
    return docs.select("doc_id", "text").mapInArrow(_encode(ranks), "doc_id long, ids binary")


def _decode(tokens):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = pa.array(tokens.value, pa.binary())
        for batch in portions(batches, "ids"):
            first, raw = _parts(batch.column("ids").fill_null(b""))
            offsets, data = _parts(token.take(pa.array(np.frombuffer(raw, dtype="<u4"))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), _binary(offsets[first // 4], data, pa.binary())], names=["doc_id", "ids", "decoded"])

    return run


def rank_decode(encoded: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids, decoded)``: the tokens' bytes in order. An id that the file lacks is an error."""
    by_id = {rank: token for token, rank in read_ranks(path).items()}
    tokens = encoded.sparkSession.sparkContext.broadcast([by_id.get(i) for i in range(max(by_id, default=-1) + 1)])  # as many as the vocabulary file has
    return encoded.select("doc_id", "ids").mapInArrow(_decode(tokens), "doc_id long, ids binary, decoded binary")


def rank_digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document."""
    decoded = rank_decode(rank_encode(docs, path), path)
    n = (F.octet_length("ids") / 4).cast("long")
    return decoded.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
