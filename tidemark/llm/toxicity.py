"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

A token that is not plain letters (leetspeak, separators between letters, long repetition, letters spaced out) spans a character
lattice: every written character offers the letters it may stand for, or nothing. The Viterbi path under a letter trigram
model, counted over **all** documents, is the restored word, whatever its length; next best paths that differ in the first two ambiguous characters
are read too. Letters spaced out have no word breaks left, so the words that the model knows are also looked for inside of restored letters.
Word and word-beginning features of written and restored
words get smoothed log-odds from labelled rows; a document's strongest features go through a logistic calibration that is
fitted on other labelled rows than the log-odds.

Only labelled rows whose ``crc32(doc_id) % 4`` is not 2 are learnt from, at most about ``TRAIN_ROWS`` of them, chosen by hash.
Scores use the text alone.

Edge cases: null and empty texts have no features and get the calibrated score of such a text. Null ``doc_id``: scored, never
held out, never learnt from. Conflicting repeated labels: toxic wins. Without labelled rows every score is 0. Repeated rows are
scored alike. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .shared import join_small, stored, whole_row
from .words import slices, utf8

TRAIN_ROWS = 60_000
MIN_SUPPORT = 4
THRESHOLD = 0.3
#: Remembered tokens of a task: their strengths, and their (larger) feature lists; and features counted until they are handed on.
MEMO_ENTRIES = 150_000
MEMO_FEATURES = 40_000
COUNTED_FEATURES = 150_000
PREFIXES = (3, 4, 5, 6, 7, 8)
#: Lengths of known words that are looked for inside of restored letters, where those are more than ``LONG``.
INSIDE, LONG = range(4, 25), 8

#: What a written character may stand for, besides itself.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
_N = 27
_EDGES = re.compile(r"^[^\w@$!|(+€£]+|[\W_]+$")
#: The same, but what may stand for a letter stays at the end too.
_OUTSIDE = re.compile(r"^[^\w@$!|(+€£]+|[^\w@$!|(+€£]+$|_+$")
#: Single characters between separators, four or more.
_SPACED = re.compile(r"(?<![^\W_])[^\W_](?:[\W_]+[^\W_](?![^\W_])){3}")
_REPEAT = re.compile(r"(.)\1\1")
_LETTER = re.compile(r"[^\W\d_]")


def _letter_codes() -> np.ndarray:
    codes = np.zeros(256, dtype=np.int64)
    for i in range(26):
        codes[ord("a") + i] = codes[ord("A") + i] = i + 1
    return codes


def _count_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes, counts = _letter_codes(), np.zeros(_N**3, dtype=np.int64)
    for batch in slices(batches):
        for text in utf8(batch.column("text")):
            for at in range(0, len(text), 1 << 20):
                c = codes[np.frombuffer(b"  " + text[max(0, at - 2) : at + (1 << 20)] + b" " if not at else text[at - 2 : at + (1 << 20)] + b" ", dtype=np.uint8)]
                counts += np.bincount((c[:-2] * _N + c[1:-1]) * _N + c[2:], minlength=_N**3)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["gram", "n"])


def letter_model(docs: DataFrame) -> np.ndarray:
    """Log-probabilities of a letter after two others (0 is a word's edge), from all texts; 27^3 numbers."""
    rows = docs.select("text").mapInArrow(_count_letters, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(_N**3)
    counts[rows.column("gram").to_numpy()] = rows.column("n").to_numpy()
    three = counts.reshape(_N, _N, _N)
    two = three.sum(axis=0) + 0.5
    lower = two / two.sum(axis=1, keepdims=True)
    smooth = (three + 5 * lower[None]) / (three.sum(axis=2, keepdims=True) + 5)
    return np.log(smooth)


class Channel:
    """Viterbi decoding of one token's character lattice."""

    def __init__(self, model: np.ndarray) -> None:
        self.model = model.tolist()
        self.code = {chr(ord("a") + i): i + 1 for i in range(26)}

    def options(self, c: str, previous: str) -> list[tuple[str, float]]:
        if c in LEET:
            return [(x, -0.7 * len(LEET[c])) for x in LEET[c]] + [("", -6.0)]
        if c.isalpha():
            # A written letter is itself; right after the same letter it may be mere repetition.
            return [(c, 0.0), ("", -1.0)] if c == previous else [(c, 0.0)]
        return [("", 0.0)]

    def decode(self, token: str) -> str:
        return self.readings(token)[0]

    def readings(self, token: str, most: int = 4) -> list[str]:
        """The best paths for the choices at the first two ambiguous characters, best first: few letters of context cannot always settle them."""
        # states: the last two letters' codes, the last letter and those choices -> (score, path)
        states = {(0, 0, "", ""): (0.0, None)}
        model, code, previous = self.model, self.code, ""
        for c in token:
            options, after = self.options(c, previous), {}
            choice = sum(x != "" for x, _ in options) > 1
            for (a, b, last, first), (score, path) in states.items():
                for x, cost in options:
                    if x == "":
                        key, s, p = (a, b, last, first), score + cost, path
                    else:
                        k = code.get(x, 0)
                        key, s, p = (b, k, x, first + x if choice and len(first) < 2 else first), score + cost + model[a][b][k], (path, x)
                    if key not in after or s > after[key][0]:
                        after[key] = (s, p)
            states, previous = after, c
        best: dict[str, tuple] = {}
        for (a, b, _, first), (score, path) in states.items():
            if first not in best or score + model[a][b][0] > best[first][0]:
                best[first] = (score + model[a][b][0], path)
        out = []
        for _, path in sorted(best.values(), key=lambda x: -x[0])[:most]:
            letters = []
            while path:
                path, x = path
                letters.append(x)
            out.append("".join(reversed(letters)))
        return out


class Features:
    """Features of a text's tokens, remembered by token."""

    def __init__(self, model: np.ndarray) -> None:
        self.channel = Channel(model)

    @staticmethod
    def of_word(word: str) -> list[str]:
        return ["=" + word, *("^" + word[:k] for k in PREFIXES if len(word) > k)] if len(word) > 2 else []

    def restored(self, token: str) -> set[str]:
        """The readings of a token's lattice; none for plain words."""
        token = _OUTSIDE.sub("", token.lower().replace(" ", ""))
        if not _LETTER.search(token) or (token.isalpha() and not _REPEAT.search(token)):
            return set()
        return {*self.channel.readings(token), "".join(_LETTER.findall(token))}

    def of_token(self, token: str) -> list[str]:
        plain = _EDGES.sub("", token.lower().replace(" ", ""))
        if not plain or not _LETTER.search(plain):
            return []
        out = self.of_word(plain)
        for word in self.restored(token) - {plain}:
            out += self.of_word(word)
        return out

    @staticmethod
    def plain_word(token: str) -> str | None:
        """The word of a token that is letters and at most closing punctuation, which has no other reading; None for other tokens."""
        word = token.lower().rstrip(",.;:?")
        return word if word.isalpha() and not _REPEAT.search(word) else None

    def known(self, token: str, wanted, heads: set[str]) -> list[str]:
        """The features of a token that are in ``wanted``, whose words begin with one of ``heads`` (:meth:`heads`)."""
        word = self.plain_word(token)
        if word is None:
            return [f for f in self.of_token(token) if f in wanted]
        return [f for f in self.of_word(word) if f in wanted] if word[:3] in heads else []

    @staticmethod
    def heads(wanted) -> set[str]:
        """The first three letters of the features' words; no feature has fewer."""
        return {f[1:4] for f in wanted}

    def inside(self, token: str) -> Iterator[str]:
        """Words that may stand within the restored letters of a token whose letters are spaced out."""
        if not _SPACED.search(token):
            return
        for word in {*self.restored(token), token.lower().replace(" ", "")}:
            if len(word) > LONG:
                for k in INSIDE:
                    for i in range(len(word) - k + 1):
                        yield "=" + word[i : i + k]

    @staticmethod
    def tokens(text: str) -> set[str]:
        """Distinct tokens; runs of three or more single characters are also read as one token, which keeps its spaces."""
        words = text.split()
        found = set(words)
        if sum(len(w) == 1 for w in found) > 2:
            run: list[str] = []
            for w in [*words, "--"]:
                if len(w) == 1:
                    run.append(w)
                    continue
                if len(run) >= 3:
                    found.add(" ".join(run))
                    # A word of one letter may stand before the run.
                    if len(run) > 3 and run[0] in "aAIiyYoO":
                        found.add(" ".join(run[1:]))
                run = []
        return found

    def of_text(self, text: str, memo: dict[str, list[str]], wanted=None, heads: set[str] = frozenset()) -> set[str]:
        """All features, or those in ``wanted``; ``memo`` is of the same kind."""
        out: set[str] = set()
        for token in self.tokens(text):
            if (f := memo.get(token)) is None:
                if len(memo) > MEMO_FEATURES:
                    memo.clear()
                f = memo[token] = self.of_token(token) if wanted is None else self.known(token, wanted, heads)
            out.update(f)
        return out


def _count_features(model: np.ndarray, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = set(wanted.value) if wanted is not None else None
        features, memo, counts = Features(model), {}, Counter()
        heads = Features.heads(only or ())

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["feature", "n"])
            counts.clear()
            return out

        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                counts.update(features.of_text(text or "", memo, only, heads))
                if len(counts) > COUNTED_FEATURES:
                    yield rows()
        yield rows()

    return run


def _feature_counts(docs: DataFrame, model: np.ndarray, wanted=None) -> DataFrame:
    return docs.select("text").mapInArrow(_count_features(model, wanted), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def log_odds(train: DataFrame, model: np.ndarray) -> dict[str, float]:
    """Feature -> lower bound of its log-odds for toxic text. A feature needs one in 500 toxic rows, so their number is bounded by 500 times the
    features of a toxic text on average."""
    sizes = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return {}
    support = max(MIN_SUPPORT, n_toxic // 500)
    seen = _feature_counts(train.where("toxic = 1"), model).where(F.col("n") >= support).toArrow()
    toxic = dict(zip(seen.column("feature").to_pylist(), seen.column("n").to_pylist()))
    wanted = train.sparkSession.sparkContext.broadcast(list(toxic))
    found = _feature_counts(train.where("toxic = 0"), model, wanted).toArrow()
    clean = dict(zip(found.column("feature").to_pylist(), found.column("n").to_pylist()))
    out = {}
    for f, t in toxic.items():
        c = clean.get(f, 0)
        w = np.log((t + 0.5) / (n_toxic + 1)) - np.log((c + 0.5) / (n_clean + 1)) - 1.3 * np.sqrt(1 / (t + 0.5) + 1 / (c + 0.5)) * (c > 0 or t < 20)
        if w > 0.7:
            out[f] = float(w)
    return out


def _strengths(model: np.ndarray, lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, features, memo = lexicon.value, Features(model), {}
        heads = Features.heads(weight)
        for batch in slices(batches):
            best, more, size = [], [], []
            for text in batch.column("text").to_pylist():
                found = []
                tokens = features.tokens(text or "")
                size.append(float(np.log1p(len(tokens))))
                for token in tokens:
                    if (w := memo.get(token)) is None:
                        if len(memo) > MEMO_ENTRIES:
                            memo.clear()
                        known = features.known(token, weight, heads)
                        if not token.isalpha():
                            known += [f for f in features.inside(token) if f in weight]
                        w = memo[token] = max(map(weight.get, known), default=0.0)
                    if w:
                        found.append(w)
                found.sort(reverse=True)
                best.append(found[0] if found else 0.0)
                more.append(float(sum(found[1:4])))
            rest = [batch.column(n) for n in batch.schema.names if n != "text"]
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*rest, *(pa.array(x, pa.float64()) for x in (best, more, size))], names=[*names, "best", "more", "size"])

    return run


def _design(best: np.ndarray, more: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(best)), best, np.maximum(best - 2, 0), more, size], axis=1)


def calibrate(rows) -> np.ndarray:
    """Logistic regression by Newton steps on (best, more, size, toxic) of the calibration rows; a ridge keeps it finite."""
    x = _design(*(rows.column(c).to_numpy() for c in ("best", "more", "size")))
    y, w = rows.column("toxic").to_numpy().astype(float), np.zeros(5)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = np.array([1e-3, 0.1, 0.1, 0.1, 0.1])
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
    return w


def _remainder(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 4


class ToxicityModel:
    """Letter model, feature log-odds and calibration; ``score`` applies them to any table with a ``text``."""

    def __init__(self, docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> None:
        spark = docs.sparkSession
        self.letters = letter_model(docs)
        labels = labels.where("doc_id is not null and toxic is not null").where(_remainder() != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        share = min(1.0, rows / max(1, labels.count()))
        chosen = stored(labels.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1_000_000)) < share * 1_000_000), "toxicity-labels")
        train = stored(join_small(docs.select("doc_id", "text"), chosen, ["doc_id"]), "toxicity-train")
        if (found := train.count()) > 1.2 * rows:  # ids that many rows share
            train = train.where(F.pmod(F.xxhash64("doc_id", "text", F.lit("rows")), F.lit(1_000_000)) < rows / found * 1_000_000)
        # Log-odds come from two of the three remainders, the calibration from the third.
        lexicon = log_odds(train.where(_remainder() != 3), self.letters)
        self.lexicon = spark.sparkContext.broadcast(lexicon)
        held = train.where(_remainder() == 3).select("toxic", "text").mapInArrow(_strengths(self.letters, self.lexicon), "toxic int, best double, more double, size double")
        held = held.toArrow()  # four numbers for each of at most ``rows`` rows
        self.weights = calibrate(held) if lexicon and held.num_rows else None

    def score(self, docs: DataFrame) -> DataFrame:
        """All columns of ``docs`` but the text, with ``score``."""
        kept = [c for c in docs.columns if c != "text"]
        schema = StructType([*(f for f in docs.schema if f.name != "text"), *(StructField(c, DoubleType()) for c in ("best", "more", "size"))])
        found = docs.mapInArrow(_strengths(self.letters, self.lexicon), schema)
        if self.weights is None:
            return found.select(*kept, F.lit(0.0).alias("score"))
        a, b, c, d, e = map(float, self.weights)
        z = F.lit(a) + b * F.col("best") + c * F.greatest(F.col("best") - 2, F.lit(0.0)) + d * F.col("more") + e * F.col("size")
        return found.select(*kept, (1 / (1 + F.exp(-z))).alias("score"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    scored = ToxicityModel(docs, labels).score(docs.select("doc_id", "text"))
    held_out = F.coalesce(_remainder() == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``THRESHOLD``, columns as they were."""
    rows = docs.select(whole_row(docs).alias("row"), "text")
    return ToxicityModel(docs, labels).score(rows).where(F.col("score") < THRESHOLD).select("row.*")
