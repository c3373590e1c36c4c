"""Personal data: span candidates from wide generators, boosted trees over format and context, calibrated thresholds.

Everything is DataFrame expressions. The base rules (``BASE``) find spans that always stay. Two wide generators a kind (``WIDE``) propose further
spans, which may overlap: other separators, masked or spelled at-signs and dots, national numbers, groups of four. One pass over the texts cuts
them into matches and the pieces between; each match then is a row with what stands before and after it, so that the rest is linear in the
number of matches, in one text or in many: positions are running sums, and overlaps are found in runs of touching spans.

Each candidate falls into one of 2^``N_FEATURES`` feature cells; the cells' counts by kind over **all** candidates of all documents are
what gradient-boosted depth-two trees are fitted on, for all kinds together. Labels are weak: candidates that touch a valid base span of
their kind are positive, others that break the kind's rule (part ranges, check digits, digit counts, known endings) negative, the rest unknown.
The features leave out what the rules look at and the base patterns' own separators, so that a masked address scores like a plain one in
its place. On held-out documents each kind gets the lowest score from which labelled candidates have the demanded precision. Of unknown candidates
above it that touch each other the best is added, unless they touch a base span.

Positions are code points, ends exclusive. Edge cases: null and empty texts have no spans; repeated rows are treated alike; a
null ``doc_id`` is kept; an empty table fits no trees and gives an empty result; extra columns pass through ``redact``.
The patterns below are linear in the text: runs are matched possessively and only from their beginnings.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, join_small, named, stored

KINDS = ("email", "ip", "card", "phone")

#: The base patterns. `[0-9]([\x20-]?[0-9])+` of 14 to 19 digits is written with its bounds, from the run's beginning to its end.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
WIDE = {
    "email": [
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:@| ?[\[({](?:at|AT|@)[\])}] ?)[A-Za-z0-9-]{1,63}+(?: ?[\[({](?:dot|DOT|\.)[\])}] ?[A-Za-z0-9-]{1,63}+|\.[A-Za-z0-9-]{1,63}+){1,8}+",
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ (?:at|AT) [A-Za-z0-9-]{1,63}+(?: (?:dot|DOT) [A-Za-z0-9-]{1,63}+){1,4}+",
    ],
    "ip": [
        r"(?<![A-Za-z0-9.,:_-])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|[.,:_-])[0-9]{1,3}){3}+(?![A-Za-z0-9]|[.,:_-][0-9])",
        r"(?<![A-Za-z0-9.])[0-9]{1,3}(?: ?(?:[\[({]dot[\])}]|dot|\.) ?[0-9]{1,3}){3}+(?![A-Za-z0-9]|\.[0-9])",
    ],
    "card": [
        r"(?<![A-Za-z0-9])[0-9](?:[ ._/-]{0,2}[0-9]){12,18}+(?![A-Za-z0-9])",
        r"(?<![A-Za-z0-9])[0-9]{4}(?:[^A-Za-z0-9\n]{1,3}[0-9]{4}){3}+(?![A-Za-z0-9])",
    ],
    "phone": [
        r"(?<![A-Za-z0-9+.])(?:\+|00)?[(]?[0-9](?:[ ()./-]{0,2}[0-9]){6,17}+(?![A-Za-z0-9])",
        r"(?<![A-Za-z0-9+.])(?:\+|00)[1-9][0-9]{0,2}(?:[^A-Za-z0-9\n]{1,3}[0-9]{2,6}){2,5}+(?![A-Za-z0-9])",
    ],
}
#: All patterns in order: (kind, is it a base pattern, pattern).
GENERATORS = [*((k, True, BASE[k]) for k in KINDS), *((k, False, p) for k in KINDS for p in WIDE[k])]
#: What a text must hold for a kind to be looked for.
HINT = {"email": r"@|[\[({ ](?:at|AT)[\])} ]", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]"}
#: Words that announce personal data in the characters before a candidate.
CONTEXT = r"(?i)tel|phone|call|fax|mobil|mail|contact|kontakt|correo|card|visa|carte|tarjeta|karte|\bip\b|host|addr|server|write"
#: Endings of addresses that are taken as known besides those of two letters.
ENDINGS = ("com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "dev", "app", "io", "test", "example")
N_FEATURES = 9
ROUNDS, RATE, PRECISION, LEAST_CASES = 60, 0.3, 0.98, 20
#: Code points of a piece of text from which redaction cuts.
_CUT = 1024


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = 2 * d - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    """The kind's rule on a match, whatever its separators."""
    digits = _digits(match)
    if kind == "email":
        return F.rlike(match, F.lit(rf"(?i)[^A-Za-z](?:[a-z]{{2}}|{'|'.join(ENDINGS)})$"))
    if kind == "ip":
        return F.forall(F.regexp_extract_all(match, F.lit("[0-9]+"), 0), lambda p: (F.length(p) <= 9) & (p.cast("int") <= 255))
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(10, 15)


def _base_ok(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        small = lambda p: (F.length(p) <= 3) & (F.coalesce(p.cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(match, r"\."), lambda p: small(F.regexp_replace(p, "^0+", "")))
    return valid(kind, match)


def _matches(number: int, kind: str, pattern: str) -> Column:
    """The pattern's leftmost non-overlapping matches in ``_body``, each with the length of the piece before it and both its neighbourhoods."""
    found, gaps = F.col(f"_found_{number}"), F.col(f"_gaps_{number}")

    def one(match: Column, i: Column) -> Column:
        before, after = F.get(gaps, i), F.get(gaps, i + 1)
        return F.struct(
            F.lit(number).alias("generator"), i.alias("place"), F.length(before).alias("gap"), F.right(before, F.lit(24)).alias("before"), match.alias("match"), F.left(after, F.lit(12)).alias("after")
        )

    return F.transform(found, one)


def cut(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_matches``, the matches of all generators in order."""
    df = docs.withColumn("_body", F.coalesce(F.col(text), F.lit("")))
    for i, (kind, _, pattern) in enumerate(GENERATORS):
        hint = F.rlike("_body", F.lit(HINT[kind]))
        df = df.withColumn(f"_found_{i}", F.when(hint, F.regexp_extract_all("_body", F.lit(pattern), 0)).otherwise(F.array().cast("array<string>")))
        df = df.withColumn(f"_gaps_{i}", F.when(F.size(f"_found_{i}") > 0, F.split("_body", pattern, -1)).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("_matches", F.concat(*(_matches(i, kind, pattern) for i, (kind, _, pattern) in enumerate(GENERATORS))))
    return df.drop("_body", *(f"_{x}_{i}" for x in ("found", "gaps") for i in range(len(GENERATORS))))


def _cell(kind: str) -> Column:
    """The feature cell, 0 .. 2^N_FEATURES - 1, of a candidate."""
    m, before, after = F.col("match"), F.col("before"), F.col("after")
    form = {
        "email": F.rlike(m, F.lit(r"^[A-Za-z]")),
        "ip": F.rlike(m, F.lit(r"^[1-9]")),
        "card": F.rlike(m, F.lit(r"^[2-6]")),
        "phone": F.rlike(m, F.lit(r"^(?:\+|00|0|\()")),
    }[kind]
    bits = [
        F.lit(kind in ("card", "phone")),
        F.lit(kind in ("ip", "phone")),
        F.rlike(before, F.lit(r"(?:^|[\s(\[<\"':|=*#%&$>])$")),
        F.rlike(after, F.lit(r"^(?:$|[\s.,;!?)#*$%&|<>\]\"':])")),
        F.rlike(before, F.lit(CONTEXT)),
        F.rlike(before, F.lit(r"[0-9].{0,3}$")),
        F.rlike(after, F.lit(r"^.{0,3}[0-9]")),
        form,
        F.rlike(m, F.lit(r"[^A-Za-z0-9]")),
    ]
    return sum((F.when(b, 1 << i).otherwise(0) for i, b in enumerate(bits)), F.lit(0))


def _by_kind(of) -> Column:
    """``of(kind)`` for the row's kind."""
    out = F.when(F.col("kind") == 0, of(KINDS[0]))
    for i, k in enumerate(KINDS[1:], 1):
        out = out.when(F.col("kind") == i, of(k))
    return out


def _islands(df: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``island``: equal numbers within ``keys`` for spans that touch, directly or by others between them."""
    by = Window.partitionBy(*keys).orderBy("start", "end", "kind", "base", "generator")
    df = df.withColumn("_reach", F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    return df.withColumn("island", F.sum(F.when(F.col("start") < F.col("_reach"), 0).otherwise(1)).over(by)).drop("_reach")


def candidates(found: DataFrame) -> DataFrame:
    """``row, held, kind, generator, base, start, end, cell, label`` of all valid base spans and all wide candidates (label: 1, 0 or null) of
    ``found(row, doc_id, _matches)``, a stored table."""
    kinds, bases = F.array(*(F.lit(KINDS.index(k)) for k, _, _ in GENERATORS)), F.array(*(F.lit(b) for _, b, _ in GENERATORS))
    rows = found.where(F.size("_matches") > 0).select("row", (F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0).alias("held"), F.inline("_matches")).repartition("row")
    size = F.length("match")
    end = F.sum(F.col("gap") + size).over(Window.partitionBy("row", "generator").orderBy("place"))
    rows = rows.withColumn("end", end.cast("int")).withColumn("start", F.col("end") - size)
    rows = rows.withColumn("kind", F.get(kinds, "generator")).withColumn("base", F.get(bases, "generator"))
    rows = rows.where(~F.col("base") | _by_kind(lambda k: _base_ok(k, F.col("match"))))
    rows = rows.withColumn("cell", F.when(~F.col("base"), _by_kind(_cell))).withColumn("ok", F.col("base") | _by_kind(lambda k: valid(k, F.col("match"))))
    rows = _islands(rows.select("row", "held", "kind", "generator", "base", "start", "end", "cell", "ok"), ["row", "kind"])
    has_base = F.max("base").over(Window.partitionBy("row", "kind", "island"))
    return rows.withColumn("label", F.when(has_base, 1).when(~F.col("ok"), 0)).drop("island", "ok")


def cell_counts(rows: DataFrame) -> DataFrame:
    """``(kind, cell, held, positive, negative)`` over all labelled candidates; at most 4 * 512 * 2 rows."""
    rows = rows.where("not base and label is not null")
    return rows.groupBy("kind", "cell", "held").agg(F.sum("label").alias("positive"), F.sum(1 - F.col("label")).alias("negative"))


class Boosted:
    """Gradient boosting of depth-two trees with logistic loss on weighted feature cells."""

    def __init__(self, cells: dict[int, tuple[int, int]], rounds: int = ROUNDS, rate: float = RATE) -> None:
        pos, neg = (sum(x[i] for x in cells.values()) for i in (0, 1))
        self.bias = math.log((pos + 1) / (neg + 1))
        self.trees: list[tuple[int, int, dict[tuple[int, int], float]]] = []
        score = {c: self.bias for c in cells}
        for _ in range(rounds):
            grad = {c: (p - (p + n) / (1 + math.exp(-score[c])), (p + n) * math.exp(-abs(score[c])) / (1 + math.exp(-abs(score[c]))) ** 2) for c, (p, n) in cells.items()}
            best = None
            for i in range(N_FEATURES):
                for j in range(i + 1, N_FEATURES):
                    leaf: dict[tuple[int, int], list[float]] = {}
                    for c, (g, h) in grad.items():
                        x = leaf.setdefault((c >> i & 1, c >> j & 1), [0.0, 1.0])
                        x[0] += g
                        x[1] += h
                    gain = sum(g * g / h for g, h in leaf.values())
                    if best is None or gain > best[0] + 1e-12:
                        best = (gain, i, j, {k: rate * g / h for k, (g, h) in leaf.items()})
            if best is None or best[0] < 1e-9:
                break
            self.trees.append(best[1:])
            for c in score:
                score[c] += best[3][c >> best[1] & 1, c >> best[2] & 1]

    def score(self, cell: int) -> float:
        return self.bias + sum(leaf.get((cell >> i & 1, cell >> j & 1), 0.0) for i, j, leaf in self.trees)


def lowest_threshold(model: Boosted, held: dict[int, tuple[int, int]], precision: float = PRECISION) -> float:
    """The lowest score from which held-out candidates have the precision; infinite if there are too few to tell."""
    best, pos, n = math.inf, 0, 0
    for c in sorted(held, key=model.score, reverse=True):
        pos, n = pos + held[c][0], n + sum(held[c])
        if n >= LEAST_CASES and pos >= precision * n:
            best = model.score(c)
    return best


class Detector:
    """Trees over all kinds and thresholds by kind, as a table: ``selected[kind * 512 + cell]`` is the score, or null below the threshold."""

    def __init__(self, counts: DataFrame) -> None:
        rows = counts.collect()  # at most 4096 small rows
        self.selected: list[float | None] = [None] * (len(KINDS) << N_FEATURES)
        fitted: dict[int, tuple[int, int]] = {}
        for r in rows:
            if not r["held"]:
                p, n = fitted.get(r["cell"], (0, 0))
                fitted[r["cell"]] = p + r["positive"], n + r["negative"]
        if not fitted:
            return
        model = Boosted(fitted)
        for kind in range(len(KINDS)):
            held = {r["cell"]: (r["positive"], r["negative"]) for r in rows if r["kind"] == kind and r["held"]}
            least = lowest_threshold(model, held)
            scores = [model.score(c) for c in range(1 << N_FEATURES)]
            self.selected[kind << N_FEATURES : (kind + 1) << N_FEATURES] = [round(s, 6) if s >= least else None for s in scores]

    def spans(self, rows: DataFrame) -> DataFrame:
        """``row, kind, start, end, base`` of the base spans and the selected candidates."""
        table = F.array(*[F.lit(x).cast("double") for x in self.selected])
        score = F.when(~F.col("base") & F.col("label").isNull(), F.get(table, F.col("kind") * (1 << N_FEATURES) + F.col("cell")))
        rows = _islands(rows.withColumn("score", score).where("base or score is not null"), ["row"])
        island = Window.partitionBy("row", "island")
        rows = rows.withColumn("closed", F.max("base").over(island))
        best = F.row_number().over(island.orderBy(F.desc("base"), F.desc("score"), "start", F.desc("end"), "kind", "generator"))
        rows = rows.withColumn("best", best).where("base or (not closed and best = 1)")
        return rows.select("row", "kind", "start", "end", "base")


def spans_of(found: DataFrame) -> DataFrame:
    """``row, base, spans`` (sorted arrays of (start, kind, end)) of those rows of ``found(row, doc_id, _matches)``, a stored table, that have spans."""
    rows = stored(candidates(found.select("row", "doc_id", "_matches")), "pii-candidates")
    span = F.struct("start", "kind", "end")
    by_row = Detector(cell_counts(rows)).spans(rows).groupBy("row")
    spans = by_row.agg(F.array_sort(F.collect_list(F.when(F.col("base"), span))).alias("base"), F.array_sort(F.collect_list(span)).alias("spans"))
    spans = stored(spans, "pii-spans")
    discard(rows)
    return spans


def joined(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _count_of(kind: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every document."""
    # The texts need not be stored with their matches: only ids and matches are.
    found = stored(cut(docs.select("doc_id", "text")).drop("text").withColumn("row", F.monotonically_increasing_id()), "pii-matches")
    spans = spans_of(found)
    df = join_small(found.select("row", "doc_id"), spans, ["row"], "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    df = df.select("doc_id", *(F.coalesce(c, none).alias(c) for c in ("base", "spans")))
    counts = [_count_of(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return df.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets, e.g. ``[EMAIL]``; overlapping spans become one.
    ``n_chars``, where there is such a column, is the new length."""
    columns = docs.columns
    keep = {c: f"_keep_{i}" for i, c in enumerate(columns)}
    df = docs.select(*(named(c).alias(k) for c, k in keep.items()), F.col("doc_id"), F.col("text"))
    found = stored(cut(df).drop("doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "pii-matches")
    text, doc_id = F.col(keep["text"]), F.col(keep["doc_id"])
    spans = spans_of(found.withColumn("doc_id", doc_id))
    # Overlapping spans are one place to cut; the pieces between are taken from parts of bounded length.
    spans = spans.select("row", F.explode("spans").alias("s")).select("row", "s.*")
    by = Window.partitionBy("row").orderBy("start", "kind", "end")
    done = F.coalesce(F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.withColumn("done", done).groupBy("row").agg(F.array_sort(F.collect_list(F.when(F.col("start") >= F.col("done"), F.struct("start", "done", "kind")))).alias("cuts"), F.max("end").alias("last"))
    df = join_small(found.drop("_matches"), stored(spans, "pii-cuts"), ["row"], "left")
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    df = df.withColumn("_parts", F.when(F.col("last").isNotNull(), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CUT}}}"), 0)))

    def piece(a: Column, b: Column) -> Column:
        part = lambda k: F.substring(F.get("_parts", k), F.greatest(a - k * _CUT, F.lit(0)) + 1, F.least(b - k * _CUT, F.lit(_CUT)) - F.greatest(a - k * _CUT, F.lit(0)))
        whole = lambda x: F.floor(x / _CUT).cast("int")
        return F.when(a < b, F.array_join(F.transform(F.sequence(whole(a), whole(b - 1)), part), "")).otherwise("")

    pieces = F.transform("cuts", lambda s: F.concat(piece(s["done"], s["start"]), F.get(names, s["kind"])))
    new = F.when(F.col("last").isNotNull(), F.concat(F.array_join(pieces, ""), piece(F.col("last"), F.length(text)))).otherwise(text)
    df = df.withColumn("_new_text", new)
    out = [F.col("_new_text").alias("text") if c == "text" else F.length("_new_text").cast("long").alias(c) if c == "n_chars" else F.col(k).alias(c) for c, k in keep.items()]
    return df.select(*out)
