"""Conversation structure repair: the cheapest edits that make a conversation's roles alternate, found by block tables.

The costs to go from a row on, one for each state of the pattern ``(s?(ua)+)?``, are a vector; a row changes it by a step that depends on the row's symbol alone
(what its role begins with, and its fault). Less their least number the vectors are few, so for each of them and each block of ``LENGTH`` symbols the next vector
and the cost added are a table, made once from the steps (the Four-Russians way). A conversation is read from its end, a block for each look-up, and the
vectors between blocks are kept. Then it is traced from its beginning: each block is expanded backward from the vector behind it, and in each place the first
letter in ASCII order is taken that keeps the total least; since a letter leads from a state to one state only, the letters chosen are the least of all
cheapest ones. What a block does from a state is remembered, in a table bounded likewise.

A conversation takes one byte a row in its task, as the audit that it returns does; texts never gather. They are sorted by conversation behind its audit and
stream through a task that holds a running hash, which their order fixes. Faults are found before, by shuffles without texts.

Order and edge cases: rows follow turn (null first); of one turn, the digest of role and text. So repeated rows stand together, and all but the first are
duplicates. Null role and text are one space, which makes a row blank; in the key of the damage null conv_id and turn are one space too. An empty role begins with
nothing, and is as illegal as any other letter. A null conv_id is one conversation. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What the edits cost.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: The pattern's states (nothing yet, after s, after u, after a) and where a letter leads.
STATES, NEXT = 4, {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
#: The letter that is put in at each state, if any: one only.
WANTED = "uuau"
#: Symbols: 0 must go; 1 to 4 begin with s, u, a or another letter; 5 to 8 likewise, truncated.
SYMBOLS = 9
LENGTH = 4


def edits(symbol: int, state: int) -> Iterator[tuple[str, int, int]]:
    """``(letter, cost, next state)`` of what can be done with a row in a state, in ASCII order."""
    yield "D", DELETE, state
    if symbol:
        late = TRUNCATED * (symbol > 4)
        if (to := NEXT.get("suax"[(symbol - 1) % 4], (None,) * STATES)[state]) is not None:
            yield "K", KEEP + late, to
        yield "R", REROLE + late, NEXT[WANTED[state]][state]


def inserted(costs: list[int]) -> tuple[int, ...]:
    """The costs where rows may be put in first."""
    for _ in range(STATES):
        costs = [min(c, INSERT + costs[NEXT[WANTED[s]][s]]) for s, c in enumerate(costs)]
    return tuple(costs)


def step(costs: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """The costs before a row, from those behind it."""
    return inserted([min(c + costs[to] for _, c, to in edits(symbol, s)) for s in range(STATES)])


#: The costs behind the last row: an empty conversation and one that ends with a may stay so.
LAST = inserted([0, 1 << 20, 1 << 20, 0])


class BlockTables:
    """For each vector of costs, less its least one, and each block of symbols: the vector before the block, and what it adds."""

    def __init__(self, length: int = LENGTH) -> None:
        self.length, self.vectors = length, [tuple(c - min(LAST) for c in LAST)]
        number = {self.vectors[0]: 0}
        to, add = [], []
        for v in self.vectors:  # grows until no step leads to a new vector
            found = [step(v, x) for x in range(SYMBOLS)]
            for w in found:
                less = tuple(c - min(w) for c in w)
                if less not in number:
                    number[less] = len(self.vectors)
                    self.vectors.append(less)
            to.append([number[tuple(c - min(w) for c in w)] for w in found])
            add.append([min(w) for w in found])
        self.step_to, self.step_add = np.array(to), np.array(add)
        #: A block's number has its first symbol as the highest digit; blocks grow at their front, where reading from the end comes last.
        block_to, block_add = np.arange(len(to))[:, None], np.zeros((len(to), 1), dtype=np.int64)
        for _ in range(length):
            block_add = (block_add[:, None, :] + self.step_add[block_to].transpose(0, 2, 1)).reshape(len(to), -1)
            block_to = self.step_to[block_to].transpose(0, 2, 1).reshape(len(to), -1)
        self.block_to, self.block_add = block_to.tolist(), block_add.tolist()
        self.traced: dict[tuple[int, int, int], tuple[bytes, int]] = {}

    def repair(self, symbols: bytes | bytearray) -> tuple[int, bytes]:
        """The least cost of a conversation's symbols, and the least of its cheapest audits."""
        length, rows = self.length, np.frombuffer(symbols, dtype=np.uint8).astype(np.int64)
        head = len(rows) % length
        codes = (rows[head:].reshape(-1, length) @ SYMBOLS ** np.arange(length - 1, -1, -1)).tolist()
        vector, total, behind, block_to, block_add = 0, min(LAST), [], self.block_to, self.block_add
        for code in reversed(codes):
            behind.append(vector)
            total += block_add[vector][code]
            vector = block_to[vector][code]
        first = rows[:head].tolist()
        inner = self.expanded(vector, first)
        state, out = 0, []
        if first:
            part, state = self.walk(inner, first, 0)
            out.append(part)
        for code in codes:
            key = behind.pop(), code, state
            if (known := self.traced.get(key)) is None:
                block = [code // SYMBOLS ** (length - 1 - i) % SYMBOLS for i in range(length)]
                known = self.traced[key] = self.walk(self.expanded(key[0], block), block, state)
            out.append(known[0])
            state = known[1]
        while LAST[state]:
            out.append(b"I")
            state = NEXT[WANTED[state]][state]
        return total + inner[0][0] - min(self.vectors[vector]), b"".join(out)

    def expanded(self, vector: int, block: list[int]) -> list[tuple[int, ...]]:
        """The costs in each place of a block, from those behind it."""
        costs = [self.vectors[vector]]
        for x in reversed(block):
            costs.append(step(costs[-1], x))
        return costs[::-1]

    def walk(self, costs: list[tuple[int, ...]], block: list[int], state: int) -> tuple[bytes, int]:
        """The first letters that keep the costs, and the state behind the block."""
        out = []
        for here, behind, x in zip(costs, costs[1:], block):
            while True:
                fits = [(a, to) for a, c, to in edits(x, state) if c + behind[to] == here[state]]
                if put := [("I", to) for to in [NEXT[WANTED[state]][state]] if INSERT + here[to] == here[state]]:
                    fits = sorted(fits + put)
                letter, state = fits[0]
                out.append(letter)
                if letter != "I":
                    break
        return "".join(out).encode(), state


# --- rows ------------------------------------------------------------------------------------------------------------


def _key(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv, known, turn, role, text, gone, digest)``: the rows after damage, and those that it drops, without text. ``conv`` is 0 where the id is null."""
    kind = F.pmod(F.crc32(F.concat_ws(":", _key("conv_id"), _key("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", kind.alias("kind"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    text = F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select(
        F.coalesce("conv_id", F.lit(0)).cast("long").alias("conv"),
        F.col("conv_id").isNotNull().alias("known"),
        F.col("turn").cast("long").alias("turn"),
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        (F.col("kind") == 0).alias("gone"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))),
    ).drop("col")
    return rows.withColumn("digest", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)))


#: Faults of rows, in the order in which the first counts.
SOUND, BLANK, DUPLICATE, LATE = 0, 1, 2, 3
_GONE = 255


def faults(rows: DataFrame) -> DataFrame:
    """``(conv, known, turn, digest, mark)`` of damaged rows, without texts: four times the fault, and what the role begins with (s, u, a, other: 0 to 3).
    Copies of an earlier turn are duplicates here; those of the same turn are told by their neighbours later. Rows that damage drops have the mark 255."""
    last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    begins = F.substring("role", 1, 1)
    initial = F.when(begins == "s", 0).when(begins == "u", 1).when(begins == "a", 2).otherwise(3)
    fault = F.when(last == "", BLANK).when(last.isin(".", "!", "?"), SOUND).otherwise(LATE)
    slim = rows.select("conv", "known", "turn", "digest", "gone", initial.alias("initial"), fault.alias("fault"))
    said = slim.where(~F.col("gone") & (F.col("fault") != BLANK)).groupBy("conv", "known", "digest").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n"))
    slim = slim.join(said.where("n > 1").drop("n"), ["conv", "known", "digest"], "left")
    earlier = F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn"))
    fault = F.when(earlier & (F.col("fault") != BLANK), DUPLICATE).otherwise(F.col("fault"))
    return slim.select("conv", "known", "turn", "digest", F.when(F.col("gone"), _GONE).otherwise(4 * fault + F.col("initial")).alias("mark"))


_AUDIT = "conv long, known boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_LEGAL = np.zeros(16, dtype=bool)
_LEGAL[[0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1]] = True  # su, ua, au


class Conversation:
    """What is held of a conversation while its rows pass: a mark each, and its turns' least, last and number."""

    def __init__(self, key: tuple[int, bool]) -> None:
        self.key, self.marks, self.first, self.last, self.turns = key, bytearray(), None, None, 0

    def add(self, marks: np.ndarray, turns: np.ndarray) -> None:
        self.marks += marks.astype(np.uint8).tobytes()
        if len(turns):
            self.turns += int((np.diff(turns) != 0).sum()) + (self.last != turns[0])
            self.first, self.last = turns[0] if self.first is None else self.first, turns[-1]

    def result(self, tables: BlockTables) -> tuple:
        marks = np.frombuffer(self.marks, dtype=np.uint8)
        fault, initial = marks >> 2, marks & 3
        counts = [int((fault == f).sum()) for f in (BLANK, DUPLICATE, LATE)]
        illegal = int((~_LEGAL[4 * initial[:-1] + initial[1:]]).sum())
        symbols = np.where((fault == BLANK) | (fault == DUPLICATE), 0, 1 + initial + 4 * (fault == LATE)).astype(np.uint8)
        cost, audit = tables.repair(symbols.tobytes())
        gaps = 0 if self.first is None else int(self.last) - int(self.first) + 1 - self.turns
        return *self.key, gaps, *counts, illegal, cost, audit.decode()


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables, now, before, out = BlockTables(), None, None, []

    def results() -> pa.RecordBatch:
        names = [x.split()[0] for x in _AUDIT.split(", ")]
        kinds = [pa.int64(), pa.bool_(), *[pa.int64()] * 6, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        conv, known, mark = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("conv", "known", "mark"))
        null = batch.column("turn").is_null().to_numpy(zero_copy_only=False)
        turn, digest = batch.column("turn").fill_null(0).to_numpy(), batch.column("digest").to_pylist()
        mark = mark.copy()
        for i, x in enumerate(digest):
            place = conv[i], known[i], null[i], turn[i], x
            if place == before and mark[i] != _GONE and mark[i] >> 2 != BLANK:
                mark[i] = 4 * DUPLICATE + (mark[i] & 3)
            before = place
        cuts = np.flatnonzero((conv[1:] != conv[:-1]) | (known[1:] != known[:-1])) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(conv)]):
            key = int(conv[i]), bool(known[i])
            if now is None or now.key != key:
                out += [now.result(tables)] if now else []
                now = Conversation(key)
            stays = mark[i:j] != _GONE
            now.add(mark[i:j][stays], turn[i:j][stays & ~null[i:j]])
        if len(out) >= 1000 or sum(len(x[-1]) for x in out) > 1 << 20:
            yield results()
            out = []
    out += [now.result(tables)] if now else []
    if out:
        yield results()


def _audited(rows: DataFrame) -> DataFrame:
    marks = faults(rows).repartition("conv", "known").sortWithinPartitions("known", "conv", "turn", "digest")
    return marks.mapInArrow(_audits, _AUDIT)


def _public(df: DataFrame) -> DataFrame:
    return df.select(F.when(F.col("known"), F.col("conv")).alias("conv_id"), *(f"`{c}`" for c in df.columns if c not in ("conv", "known")))


def audits(conversations: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` of every conversation."""
    return _public(_audited(damaged(conversations)))


def _ordered(conversations: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows in order, in one partition."""
    rows = damaged(conversations)
    header = _audited(rows)
    names = [x.split()[0] for x in _AUDIT.split(", ")[2:]]
    texts = rows.where("not gone").select("conv", "known", F.lit(1).alias("kind"), "turn", "digest", "role", "text")
    both = header.withColumn("kind", F.lit(0)).unionByName(texts, allowMissingColumns=True)
    return both.repartition("conv", "known").sortWithinPartitions("known", "conv", "kind", "turn", "digest").select("conv", "known", "kind", *names, "role", "text")


_ROLE = {"u": "user", "a": "assistant"}


class Repair:
    """Applies an audit to a conversation's rows as they come."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, 0

    def put(self) -> str:
        """The role that is put in, or given, here."""
        letter = WANTED[self.state]
        self.state = NEXT[letter][self.state]
        return _ROLE[letter]

    def before(self) -> Iterator[tuple[str, str]]:
        """The rows put in here."""
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self.put(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.before()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = NEXT[role[0]][self.state]
            yield role, text
        elif letter == "R":
            yield self.put(), text


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple | None, str, str]]:
    """``(header, role, text)``: of each conversation its header alone, then its repaired rows."""
    repair = None
    for batch in batches:
        head = [c for c in batch.schema.names if c not in ("kind", "role", "text")]
        columns = [batch.column(c).to_pylist() for c in head]
        audit = columns[head.index("audit")]
        for i, (kind, role, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("kind", "role", "text")))):
            if kind == 0:
                if repair:
                    yield from ((None, *x) for x in repair.before())
                repair = Repair(audit[i])
                yield tuple(c[i] for c in columns), "", ""
            else:
                yield from ((None, *x) for x in repair.row(role, text))
    if repair:
        yield from ((None, *x) for x in repair.before())


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, key, place, size = [], None, 0, 0
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.string()))], names=["conv", "known", "place", "role", "text"])
    for header, role, text in _repaired(batches):
        if header is not None:
            key, place = header[:2], 0
            continue
        out.append((*key, place, role, text))
        place, size = place + 1, size + len(text)
        if len(out) >= 10_000 or size > 1 << 22:
            yield batch()
            out, size = [], 0
    if out:
        yield batch()


def repaired(conversations: DataFrame) -> DataFrame:
    """``conv_id, place, role, text``: the repaired conversations' rows, whose places count from 0."""
    return _public(_ordered(conversations).mapInArrow(_rows, "conv long, known boolean, place long, role string, text string"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [*(x.split()[0] for x in _AUDIT.split(", ")), "repaired_sha256"]
    kinds = [pa.int64(), pa.bool_(), *[pa.int64()] * 6, pa.string(), pa.string()]
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
    out, now, sha, between = [], None, None, b""
    for header, role, text in _repaired(batches):
        if header is not None:
            out += [(*now, sha.hexdigest())] if now else []
            now, sha, between = header, hashlib.sha256(), b""
            if len(out) >= 1000 or sum(len(x[-2]) for x in out) > 1 << 20:
                yield batch()
                out = []
        else:
            sha.update(between + role.encode() + b":" + text.encode())
            between = b"\n"
    if now:
        out.append((*now, sha.hexdigest()))
        yield batch()


def repair_digests(conversations: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of every conversation."""
    return _public(_ordered(conversations).mapInArrow(_digests, f"{_AUDIT}, repaired_sha256 string"))
