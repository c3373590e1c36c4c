"""Token counts, and BPE encoding and decoding through a distinct-word table.

Encoding: (1) every whole text is split into pre-token words, many texts at a time: spans at white space are numbered, and only distinct ones are cut further, and the distinct words are counted by Spark; (2) each distinct
word is encoded once; (3) ids come back by position: of the most frequent words (``TABLE_BYTES`` of words and ids at most) by a
broadcast join; every other word leaves a hole. One pass over the texts gives the holes' words, which join the table by a shuffle and
are gathered by document; another gives the ids and fills the holes in order, so that ids themselves are never moved or stored; (4) decoding joins ids to pieces of the
vocabulary, whose size is fixed.

Edge cases: null and empty texts have 0 tokens. Repeated rows are encoded alike, each on its own row. Empty tables give empty
results. A null ``doc_id`` is kept. Extra columns are ignored. Texts may be of any length.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, stored
from .words import portions, slices, utf8

#: Size of the words and ids that are joined by broadcast; as a table in a worker they take some ten times that.
TABLE_BYTES = 8 << 20
MEMO_ENTRIES = 120_000
#: The pre-token pattern of byte-level BPE files of this family.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Bpe:
    """The vocabulary file: merge ranks over bytes, and the special tokens that are cut out of texts first."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        shifted = [b for b in range(256) if b not in plain]
        to_byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}
        raw = lambda piece: bytes(to_byte[c] for c in piece)
        vocab = spec["model"]["vocab"]
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.ids = {raw(p): i for p, i in vocab.items() if p not in special}
        self.ranks = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[raw(a), raw(b)] = rank
        self.special = special
        #: How ids are stored within a job; its largest number stands for a hole.
        self.width = "<u2" if max(vocab.values(), default=0) < 0xFFFF > max(special.values(), default=0) else "<u4"
        self.pieces = {i: p for p, i in self.ids.items()} | {i: c.encode() for c, i in special.items()}

    def encode_word(self, word: bytes) -> list[int]:
        parts = [word[i : i + 1] for i in range(len(word))]
        return [self.ids[p] for p in (self._merge_short(parts) if len(parts) <= 48 else self._merge_long(parts))]

    def _merge_short(self, parts: list[bytes]) -> list[bytes]:
        get, none = self.ranks.get, len(self.ranks)
        rank = [get(p, none) for p in zip(parts, parts[1:])]
        while rank and (best := min(rank)) < none:
            i = rank.index(best)
            parts[i] += parts.pop(i + 1)
            del rank[i]
            if i < len(rank):
                rank[i] = get((parts[i], parts[i + 1]), none)
            if i:
                rank[i - 1] = get((parts[i - 1], parts[i]), none)
        return parts

    def _merge_long(self, parts: list[bytes]) -> list[bytes]:
        """The same merges with a heap, so that a word of n bytes takes n log n steps."""
        n, ranks = len(parts), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, b""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := ranks.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p in parts if p]


#: Classes of bytes in UTF-8 text: space, other white space, first bytes of wider characters that may be white space.
_SPACE, _OTHER_SPACE, _WIDE_SPACE, _LEAD = 1, 2, 3, 4
_WIDE_SPACES = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_WIDE_CODES = np.array([int.from_bytes(x.ljust(3, b"\0"), "big") for x in _WIDE_SPACES])
_BYTE_CLASS = np.zeros(256, dtype=np.uint8)
_BYTE_CLASS[9:14] = _OTHER_SPACE
_BYTE_CLASS[32] = _SPACE
_BYTE_CLASS[[x[0] for x in _WIDE_SPACES]] = _LEAD


def _span_starts(data: np.ndarray) -> np.ndarray:
    """Bytes of UTF-8 text at which a word begins whatever stands around: the first of each run of white space, and the first after a line end
    or tab that stands alone. What a run is cut into depends on what follows it alone, and of single ones only a space joins the next word."""
    kind = _BYTE_CLASS[data]
    lead = np.flatnonzero(kind == _LEAD)
    if len(lead):
        kind[lead] = 0
        wide = np.concatenate([data, np.zeros(2, dtype=np.uint8)]).astype(np.int64)
        two = data[lead] < 0xE0
        code = wide[lead] << 16 | wide[lead + 1] << 8 | np.where(two, 0, wide[lead + 2])
        is_space = np.isin(code, _WIDE_CODES)
        kind[lead[is_space]] = kind[lead[is_space] + 1] = kind[lead[is_space & ~two] + 2] = _WIDE_SPACE
    space = kind != 0
    start = np.zeros(len(data), dtype=bool)
    start[1:] = space[1:] & ~space[:-1]
    start[2:] |= ~space[2:] & (kind[1:-1] == _OTHER_SPACE) & ~space[:-2]
    return start


def _binary(offsets: np.ndarray, data: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A column of texts or bytes over ``data``."""
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a column of texts or bytes without nulls."""
    if not len(column):
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], data


class Spans(NamedTuple):
    """Texts in spans whose words do not depend on their surroundings: each distinct span once, and by place its number there.
    The places of text i are ``first[i]`` .. ``first[i + 1]``."""

    distinct: pa.Array
    codes: np.ndarray
    first: np.ndarray


class Splitter:
    """Cuts texts into spans, many texts at a time, and spans into pre-token words. A special token is a span of its own."""

    def __init__(self, special: list[str]) -> None:
        self.find = regex.compile(PRETOKEN).findall
        self.any_special = "|".join(map(re.escape, sorted(special, key=len, reverse=True)))
        self.special = regex.compile(f"({self.any_special})") if special else None

    def read(self, column: pa.Array) -> Spans:
        texts = column.cast(pa.string()).fill_null("")
        place = np.arange(len(texts) + 1)
        if self.special is not None and pc.any(pc.match_substring_regex(texts, self.any_special)).as_py():
            cut = [[x for x in self.special.split(t) if x] for t in texts.to_pylist()]
            place = np.cumsum([0, *map(len, cut)])
            texts = pa.array([x for c in cut for x in c], pa.string())
        offsets, data = _parts(texts)
        start = _span_starts(data)
        start[offsets[:-1][offsets[:-1] < len(data)]] = True
        at = np.flatnonzero(start)
        spans = _binary(np.append(at, len(data)), data, pa.string()).dictionary_encode()
        return Spans(spans.dictionary, spans.indices.to_numpy(), np.searchsorted(at, offsets)[place])

    def spans(self, text: str) -> list[str]:
        """The spans of one text, in order."""
        read = self.read(pa.array([text], pa.string()))
        return read.distinct.take(pa.array(read.codes)).to_pylist()


def _words(span: str, find) -> list[str]:
    """The words of a span. Letters of the Latin alphabet after at most one space, with or without a sentence's marks behind them, spare the pattern."""
    core = span.rstrip(".,;:!?")
    letters = core[1:] if core[:1] == " " else core
    if letters.isalpha() and (letters.isascii() or max(letters) < "\u0250"):
        return [span] if len(core) == len(span) else [core, span[len(core) :]]
    return find(span)


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def _count_words(special: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter(special)
        for batch in portions(batches, "text", 4 << 20):
            spans = split.read(batch.column("text"))
            counts = np.bincount(spans.codes, minlength=len(spans.distinct)).tolist()
            total: dict[str, int] = {}
            for span, n in zip(_strings(spans.distinct), counts):
                for w in () if span in special else _words(span, split.find):
                    total[w] = total.get(w, 0) + n
            yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

    return run


def distinct_words(docs: DataFrame, bpe: Bpe) -> DataFrame:
    """``(word, n)``: each distinct pre-token word of all texts, with its count."""
    counted = docs.select("text").mapInArrow(_count_words(list(bpe.special)), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _encode_words(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(path)
        for batch in slices(batches):
            ids = [np.array(bpe.encode_word(w), dtype=bpe.width).tobytes() for w in utf8(batch.column("word"))]
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(ids, pa.binary())], names=["word", "n", "ids"])

    return run


def encoded_words(docs: DataFrame, path: str) -> DataFrame:
    """The distinct-word table ``(word, n, ids)``; ids are little-endian unsigned integers of the vocabulary's width."""
    return distinct_words(docs, Bpe(path)).mapInArrow(_encode_words(path), "word string, n long, ids binary")


def _count_bin() -> Column:
    return F.floor(F.log2("n") * 8)


def frequent(table: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """The words of the highest count bins that have ``most`` bytes of words and ids together at most; are these all words?"""
    size = F.sum(F.octet_length("word") + F.octet_length("ids"))
    rows = table.groupBy(_count_bin().alias("bin")).agg(size.alias("size")).collect()  # at most 8 * 64 bins
    left, lowest = most, 1 << 20
    for r in sorted(rows, key=lambda r: -r["bin"]):
        left -= r["size"]
        if left < 0:
            return table.where(_count_bin() >= lowest), False
        lowest = r["bin"]
    return table, True


class PositionJoin:
    """ids of texts by their words' positions, with a hole for each word that is not among the frequent ones."""

    def __init__(self, known: dict[str, bytes], special: dict[str, int], width: str) -> None:
        self.known, self.split, self.width = known, Splitter(list(special)), np.dtype(width)
        self.special = {c: np.array([i], dtype=width).tobytes() for c, i in special.items()}
        self.hole = b"\xff" * self.width.itemsize
        #: Special tokens, and remembered spans of several words of the table. Starts anew after ``MEMO_ENTRIES`` spans.
        self.memo = dict(self.special)

    def _found(self, distinct: pa.Array) -> tuple[list[bytes], list[int], list[int], list[str]]:
        """The ids of each span; and of the spans with holes their numbers, how many holes each has, and all holes' words in order."""
        spans, get, memo, find = _strings(distinct), self.known.get, self.memo, self.split.find
        numbers, holes, rare = [], [], []
        # A span that is a word of the table is that word alone.
        ids = list(map(get, spans))
        for i in [i for i, x in enumerate(ids) if x is None]:
            span = spans[i]
            if (known := memo.get(span)) is None:
                words = _words(span, find)
                parts = [get(w, self.hole) for w in words]
                known = b"".join(parts)
                if self.hole in parts:
                    missing = [w for w, x in zip(words, parts) if x is self.hole]
                    numbers.append(i)
                    holes.append(len(missing))
                    rare += missing
                else:
                    if len(memo) >= MEMO_ENTRIES:
                        memo.clear()
                        memo.update(self.special)
                    memo[span] = known
            ids[i] = known
        return ids, numbers, holes, rare

    def encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's begin and end."""
        spans = self.split.read(texts)
        offsets, data = _parts(pa.array(self._found(spans.distinct)[0], pa.binary()).take(pa.array(spans.codes)))
        return np.frombuffer(data, dtype=self.width), offsets[spans.first] // self.width.itemsize

    def rare(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Of each hole, in order: the index of its text, its number within the text, and its word."""
        spans = self.split.read(texts)
        _, numbers, holes, rare = self._found(spans.distinct)
        row = np.full(len(spans.distinct), -1, dtype=np.int64)
        row[numbers] = np.arange(len(numbers))
        places = np.flatnonzero(row[spans.codes] >= 0)
        words = pa.ListArray.from_arrays(np.cumsum([0, *holes], dtype=np.int32), pa.array(rare, pa.string())).take(pa.array(row[spans.codes[places]]))
        place = np.repeat(places, pc.list_value_length(words).to_numpy())
        text = np.searchsorted(spans.first, place, side="right") - 1
        return text, np.arange(len(text)) - np.searchsorted(text, text), words.flatten()

    def ids(self, text: str) -> tuple[bytes, list[str]]:
        """The ids of one text, and the words of its holes in order."""
        texts = pa.array([text], pa.string())
        return self.encoded(texts)[0].tobytes(), self.rare(texts)[2].to_pylist()


def _holes(known, special):
    """``(key, at, word)`` of each hole of each text; ``at`` is its number as four bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join = PositionJoin(dict(zip(*known.value)), special, "<u2")
        for batch in portions(batches, "text"):
            text, at, word = join.rare(batch.column("text"))
            at = _binary(4 * np.arange(len(at) + 1), np.frombuffer(at.astype(">u4").tobytes(), dtype=np.uint8), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(text)), at, word], names=["key", "at", "word"])

    return run


def _filled(ids: bytes, found: list[dict] | None, width: str) -> bytes:
    """The ids, widened, with those of the holes' words in their places."""
    whole = np.frombuffer(ids, dtype=width)
    holes = np.flatnonzero(whole == np.iinfo(width).max)
    at = {x["at"]: x["ids"] for x in found or []}
    if len(holes) != len(at):
        raise ValueError(f"{len(holes)} holes and {len(at)} words")
    if len(holes):
        parts, last = [], 0
        for k, i in enumerate((holes * whole.itemsize).tolist()):
            parts += (ids[last:i], at[k])
            last = i + whole.itemsize
        whole = np.frombuffer(b"".join([*parts, ids[last:]]), dtype=width)
    return whole.astype("<u4").tobytes()


def _fill(known, special, width):
    """The ids of each text, with those of ``found`` (a hole's number and ids in one) in its holes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join = PositionJoin(dict(zip(*known.value)), special, width)
        for batch in portions(batches, "text"):
            ids, first = join.encoded(batch.column("text"))
            found = batch.column("found")
            if found.null_count == len(found) and not np.any(ids == np.iinfo(width).max):
                filled = _binary(4 * first, ids.astype("<u4").view(np.uint8), pa.binary())
            else:
                filled = []
                for i, x in enumerate(found.to_pylist()):
                    x = [{"at": int.from_bytes(y[:4], "big"), "ids": y[4:]} for y in x or []]
                    filled.append(_filled(ids[first[i] : first[i + 1]].tobytes(), x, width))
                filled = pa.array(filled, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), filled], names=["doc_id", "ids"])

    return run


def bpe_encode(docs: DataFrame, path: str, most: int = TABLE_BYTES) -> DataFrame:
    """``(doc_id, ids)`` of every row: the ids of the whole text as little-endian unsigned 32-bit integers."""
    spark, bpe = docs.sparkSession, Bpe(path)
    words = stored(encoded_words(docs, path), "bpe-words")
    head, complete = frequent(words, most)
    table = head.select("word", "ids").toArrow()  # at most ``most`` bytes of words and ids
    known = spark.sparkContext.broadcast((table.column("word").to_pylist(), table.column("ids").to_pylist()))
    fill = _fill(known, bpe.special, bpe.width)
    if complete:
        # Every word is in the table: there are no holes to fill.
        return docs.select("doc_id", "text", F.lit(None).cast("array<binary>").alias("found")).mapInArrow(fill, "doc_id long, ids binary")
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    holes = docs.select("key", "text").mapInArrow(_holes(known, bpe.special), "key long, at binary, word string")
    # Repeated rows have one key and the same holes, of which a set keeps one each.
    found = holes.join(words.select("word", "ids").hint("shuffle_hash"), "word").groupBy("key").agg(F.collect_set(F.concat("at", "ids")).alias("found"))
    found = stored(found, "bpe-found")
    discard(words)
    return docs.join(found.hint("shuffle_merge"), "key", "left").select("doc_id", "text", "found").mapInArrow(fill, "doc_id long, ids binary")


def _texts(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    """The bytes as texts; what is not UTF-8 becomes replacement characters."""
    raw = _binary(offsets, data, pa.binary())
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())


def _decode(pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = pa.array(pieces.value, pa.binary())
        for batch in portions(batches, "ids"):
            first, raw = _parts(batch.column("ids").fill_null(b""))
            offsets, data = _parts(piece.take(pa.array(np.frombuffer(raw, dtype="<u4"))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), _texts(offsets[first // 4], data)], names=["doc_id", "ids", "decoded"])

    return run


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids, decoded)``: each id joined to its piece of the vocabulary, in order."""
    by_id = Bpe(path).pieces
    pieces = encoded.sparkSession.sparkContext.broadcast([by_id.get(i, b"") for i in range(max(by_id, default=-1) + 1)])  # as many as the vocabulary file has
    return encoded.select("doc_id", "ids").mapInArrow(_decode(pieces), "doc_id long, ids binary, decoded string")


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document."""
    decoded = bpe_decode(bpe_encode(docs, path), path)
    n = (F.octet_length("ids") / 4).cast("long")
    return decoded.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


# --- greedy word-piece lengths ---------------------------------------------------------------------------------------


class LongestMatch:
    """Counts the pieces of greedy longest-match splitting in time linear in the word.

    A trie over the pieces' bytes. For each node, ``fail`` is where matching goes on when no edge fits, after as many pieces
    have been popped from the front as ``popped`` says; both are filled in breadth-first order when the trie is built, so a
    word is read once and no piece is ever cut out. Words that cannot be covered have no count.
    """

    def __init__(self, pieces: list[bytes]) -> None:
        self.edges: list[dict[int, int]] = [{}]
        final = [False]
        for piece in pieces:
            node = 0
            for b in piece:
                if b not in self.edges[node]:
                    self.edges[node][b] = len(self.edges)
                    self.edges.append({})
                    final.append(False)
                node = self.edges[node][b]
            final[node] = bool(piece)
        self.fail, self.popped = [-1] * len(self.edges), [0] * len(self.edges)
        queue = [0]
        for node in queue:
            for b, child in self.edges[node].items():
                if final[child]:
                    # The whole path is one piece: pop it and start anew.
                    self.fail[child], self.popped[child] = 0, 1
                else:
                    at, n = self.fail[node], self.popped[node]
                    while at >= 0 and b not in self.edges[at]:
                        n += self.popped[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[child], self.popped[child] = self.edges[at][b], n
                queue.append(child)

    def count(self, word: bytes) -> int | None:
        node, n, edges, fail, popped = 0, 0, self.edges, self.fail, self.popped
        for b in word:
            while b not in edges[node]:
                n += popped[node]
                node = fail[node]
                if node < 0:
                    return None
            node = edges[node][b]
        while node > 0:
            n += popped[node]
            node = fail[node]
        return n if node == 0 else None


def word_pieces(path: str) -> list[bytes]:
    """Pieces of a byte-level vocabulary file. Those that begin a word start with the space byte, so one trie serves both
    word-initial and continuing pieces: a word is read with a space before it."""
    return list(Bpe(path).ids)


class WordCounts(dict):
    """Piece counts by word, worked out on first use. Forgets everything at ``MEMO_ENTRIES`` words."""

    def __init__(self, automaton: LongestMatch) -> None:
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO_ENTRIES:
            self.clear()
        n = self.automaton.count(b" " + word)
        n = self[word] = 1 if n is None else n
        return n


def _piece_counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = WordCounts(LongestMatch(word_pieces(path)))
        for batch in slices(batches):
            words = [x.split() for x in utf8(batch.column("text"))]
            n = [sum(map(counts.__getitem__, x)) for x in words]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(map(len, words)), pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_words", "n_pieces"])

    return run


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_words, n_pieces``: greedy longest-match pieces of each word of every whole text; a word that the
    vocabulary cannot cover counts as one piece."""
    return docs.select("doc_id", "text").mapInArrow(_piece_counts(path), "doc_id long, n_words long, n_pieces long")


def tokenizer_path(spark: SparkSession, name: str = "byte_bpe_50k.json") -> str:
    """Where a public vocabulary file lies; ``tidemark.tokenizers`` in the session's settings names another folder."""
    folder = spark.conf.get("tidemark.tokenizers", None)
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


