"""Mixing sources to target weights over a domain - language - source tree.

The token budget flows down the tree. At each node it is split among the children by weight; a child cannot take more than its
subtree holds (tokens times ``max_epochs``), and what it cannot take goes to its siblings by weight. Since a node is only given what its
subtree holds, a shortage reaches the node's own siblings only when all children are full: siblings come before ancestors.
A leaf's allocation is whole epochs plus a prefix of one more epoch, in the order of a seeded hash of epoch, ``doc_id`` and text.

The prefix's end is found without ordering a leaf in one task: hash-range buckets are summed, and only the bucket that holds the
end is ordered. All amounts are integers.

Edge cases: null and empty texts have 0 tokens; null language or source is the leaf ``(none)``; a null ``doc_id`` hashes as the empty
string; rows equal in ``doc_id`` and text are chosen together, and if the prefix ends among them they share the rest equally;
an empty table gives an empty result; weights of names that are not listed are 1; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import join_small, stored, whole_row

LEVELS = ("domain", "lang", "source")
SEED = 17
MAX_EPOCHS = 3
#: Of all tokens, in percent.
BUDGET_PERCENT = 80
WEIGHTS = {
    "domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1},
    "lang": {"en": 5, "de": 2, "fr": 2, "es": 1},
    "source": {},
}
BUCKET_ROWS = 2048
WORD = r"[^\x20\x09-\x0D]+"
NONE = "(none)"


def domain_of(source: Column) -> Column:
    """The domain of a source: the remainder by 4 of the number at its end."""
    return F.concat(F.lit("d"), F.coalesce(F.regexp_extract(source, "([0-9]{1,9})$", 1).try_cast("int") % 4, F.lit(0)).cast("string"))


def order_key(epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("digest")))


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(1).cast("long")
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, F.lit(w).cast("long")).otherwise(out)
    return out


def split_budget(children: DataFrame, parent: list[str], level: str) -> DataFrame:
    """Adds ``amount``: the parent's ``given`` split among children ``(cap, weight)`` by weight, none above its cap."""
    order = [F.col("cap") / F.col("weight"), F.col(level)]
    by = Window.partitionBy(*parent).orderBy(*order) if parent else Window.partitionBy(F.lit(0)).orderBy(*order)
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = children.withColumn("_before", F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    df = df.withColumn("_weights", F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
    df = df.withColumn("_full", F.col("cap") * F.col("_weights") <= (F.col("given") - F.col("_before")) * F.col("weight"))
    df = df.withColumn("_left", F.col("given") - F.sum(F.when(F.col("_full"), F.col("cap")).otherwise(0)).over(whole))
    df = df.withColumn("_open", F.sum(F.when(F.col("_full"), 0).otherwise(F.col("weight"))).over(whole))
    df = df.withColumn("_share", F.when(F.col("_full"), F.lit(0)).otherwise(F.expr("_left * weight div _open")))
    df = df.withColumn("_over", F.col("_left") - F.sum("_share").over(whole)).withColumn("_rank", F.sum(F.when(F.col("_full"), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    amount = F.when(F.col("_full"), F.col("cap")).otherwise(F.col("_share") + F.when(F.col("_rank") <= F.col("_over"), 1).otherwise(0))
    return df.withColumn("amount", amount.cast("long")).drop(*(c for c in df.columns if c[0] == "_"))


def leaf_amounts(leaves: DataFrame, weights: dict[str, dict[str, int]], percent: int, max_epochs: int) -> DataFrame:
    """``leaves(domain, lang, source, tokens)`` with ``amount``, the tokens that each is to give."""
    nodes = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    total = leaves.agg((F.coalesce(F.sum("tokens"), F.lit(0)) * percent / 100).cast("long").alias("given"))
    given = total.crossJoin(nodes.agg(F.coalesce(F.sum("cap"), F.lit(0)).alias("most"))).select(F.least("given", "most").alias("given"))  # one row each
    parents: list[str] = []
    for level in LEVELS:
        path = [*parents, level]
        child = nodes.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(level, weights))
        child = child.join(given, parents) if parents else child.crossJoin(given)
        given = split_budget(child, parents, level).select(*path, F.col("amount").alias("given"))
        parents = path
    return leaves.join(given.withColumnRenamed("given", "amount"), list(LEVELS))


def mix(docs: DataFrame, weights: dict[str, dict[str, int]] = WEIGHTS, percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """``doc_id, domain, lang, source, n_tokens, digest, full_epochs, prefix_tokens, taken_tokens`` of every row: how often the
    document is taken whole, and how many of its first tokens the last, partial epoch takes."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(c)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", domain_of(F.col("source")).alias("domain"), name("lang"), name("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_tokens"), F.md5(text).alias("digest"))
    rows = stored(rows, "mix-rows")
    leaf = list(LEVELS)
    leaves = rows.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_rows"))
    amounts = leaf_amounts(stored(leaves, "mix-leaves"), weights, percent, max_epochs)
    full = F.when(F.col("tokens") > 0, F.expr("amount div tokens")).otherwise(0)
    leaves = stored(amounts.withColumn("full_epochs", full).withColumn("rest", F.col("amount") - F.col("full_epochs") * F.col("tokens")), "mix-amounts")
    buckets = (F.expr(f"n_rows div {BUCKET_ROWS}") + 1).cast("long")
    keyed = join_small(rows, leaves.select(*leaf, "full_epochs", "rest", buckets.alias("buckets")), leaf)
    keyed = keyed.withColumn("key", order_key(F.col("full_epochs"), seed))
    keyed = keyed.withColumn("bucket", F.expr("cast(conv(substr(key, 1, 8), 16, 10) as long) * buckets div 4294967296"))
    open_ = keyed.where("rest > 0")
    sums = open_.groupBy(*leaf, "bucket", "rest").agg(F.sum("n_tokens").alias("tokens"))
    sums = sums.withColumn("before", F.sum("tokens").over(Window.partitionBy(*leaf).orderBy("bucket")) - F.col("tokens"))
    last = stored(sums.where("before < rest and rest <= before + tokens").select(*leaf, "bucket", "before"), "mix-last")
    inside = join_small(open_, last, [*leaf, "bucket"]).groupBy(*leaf, "key", "rest", "before").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n"))
    upto = F.col("before") + F.sum("tokens").over(Window.partitionBy(*leaf).orderBy("key"))
    inside = inside.withColumn("upto", upto).where("upto - tokens < rest and rest <= upto")
    ends = inside.select(*leaf, F.col("key").alias("end_key"), F.expr("(rest - upto + tokens) div n").alias("end_tokens"))
    ends = stored(leaves.select(*leaf, "full_epochs").join(ends, leaf, "left"), "mix-ends")
    out = join_small(rows, ends, leaf).withColumn("key", order_key(F.col("full_epochs"), seed))
    prefix = F.when(F.col("key") < F.col("end_key"), F.col("n_tokens")).when(F.col("key") == F.col("end_key"), F.least("n_tokens", "end_tokens")).otherwise(0).cast("long")
    out = out.withColumn("prefix_tokens", prefix)
    return out.select("doc_id", *leaf, "n_tokens", "digest", "full_epochs", "prefix_tokens", (F.col("full_epochs") * F.col("n_tokens") + F.col("prefix_tokens")).alias("taken_tokens"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: each row of ``docs`` once for each whole epoch, and once more, cut to its prefix, for the partial one.
    ``n_chars``, where there is such a column, is the length of the text as it is then."""
    taken = mix(docs, **options).where("taken_tokens > 0").select("doc_id", "digest", "n_tokens", "full_epochs", "prefix_tokens").distinct()
    # The whole row is one column, so no name of the table's own is in the way.
    left = docs.select(whole_row(docs).alias("row"), F.col("doc_id").alias("row_id"), F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("row_digest"))
    taken = stored(taken, "mix-taken")
    joined = left.join(taken, (F.col("row_digest") == F.col("digest")) & F.col("row_id").eqNullSafe(F.col("doc_id")))
    none = F.array().cast("array<bigint>")
    copies = F.transform(F.sequence(F.lit(1), F.col("full_epochs").cast("int")), lambda _: F.col("n_tokens"))
    copies = F.concat(F.when(F.col("full_epochs") > 0, copies).otherwise(none), F.when(F.col("prefix_tokens") > 0, F.array("prefix_tokens")).otherwise(none))
    df = joined.select("row", "n_tokens", F.explode(copies).alias("take"))
    text = F.col("row")["text"]
    cut = F.call_function("regexp_extract", text, F.concat(F.lit(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), F.col("take").cast("string"), F.lit("}+")), F.lit(0))
    df = df.select("row", F.when(F.col("take") < F.col("n_tokens"), cut).otherwise(text).alias("new"))
    return df.select(*(F.col("new").alias(c) if c == "text" else F.length("new").cast("long").alias(c) if c == "n_chars" else F.col("row").getField(c).alias(c) for c in docs.columns))


def _sql_weight(level: str) -> str:
    cases = " ".join(f"when '{k}' then {w}" for k, w in WEIGHTS[level].items())
    return f"(case {level} {cases} else 1 end)" if cases else "1"


def _sql_level(level: str, parents: list[str], given: str) -> str:
    path = ", ".join([*parents, level])
    by = f"partition by {', '.join(parents)}" if parents else ""
    on = f"join {given} using ({', '.join(parents)})" if parents else f"cross join {given}"
    return f"""
    {level}_1 as (select {path}, cap, weight, given,
        coalesce(sum(cap) over ({by} order by cap / weight, {level} rows between unbounded preceding and 1 preceding), 0) as before,
        sum(weight) over ({by} order by cap / weight, {level} rows between current row and unbounded following) as weights
      from (select {path}, sum(cap)::hugeint as cap, {_sql_weight(level)} as weight from leaves group by {path}) {on}),
    {level}_2 as (select *, cap * weights <= (given - before) * weight as is_full from {level}_1),
    {level}_3 as (select *, given - coalesce(sum(cap) filter (is_full) over ({by}), 0) as rest, sum(weight) filter (not is_full) over ({by}) as open from {level}_2),
    {level}_4 as (select *, case when is_full then 0 else rest * weight // open end as share from {level}_3),
    {level}_5 as (select *, rest - sum(share) over ({by}) as more,
        sum(case when is_full then 0 else 1 end) over ({by} order by cap / weight, {level} rows between unbounded preceding and current row) as nth from {level}_4),
    {level}_given as (select {path}, case when is_full then cap else share + case when nth <= more then 1 else 0 end end as given from {level}_5)"""


SQL = rf"""
with docs as (
    select doc_id, 'd' || coalesce(try_cast(nullif(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') as int) % 4, 0) as domain,
        coalesce(lang, '{NONE}') as lang, coalesce(source, '{NONE}') as source,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as n_tokens, md5(coalesce(text, '')) as digest
    from documents),
leaves as (select domain, lang, source, sum(n_tokens)::hugeint as tokens, sum(n_tokens)::hugeint * {MAX_EPOCHS} as cap from docs group by all),
root as (select least(sum(tokens) * {BUDGET_PERCENT} // 100, sum(cap)) as given from leaves),
{_sql_level("domain", [], "root")},
{_sql_level("lang", ["domain"], "domain_given")},
{_sql_level("source", ["domain", "lang"], "lang_given")},
amounts as (select *, case when tokens > 0 then given // tokens else 0 end as full_epochs, given - (case when tokens > 0 then given // tokens else 0 end) * tokens as rest
    from leaves join source_given using (domain, lang, source)),
keyed as (select docs.*, full_epochs, rest, md5(concat_ws('|', '{SEED}', full_epochs::varchar, coalesce(doc_id::varchar, ''), digest)) as key
    from docs join amounts using (domain, lang, source)),
ends as (select *, sum(n_tokens) over (partition by domain, lang, source order by key range between unbounded preceding and current row) as upto,
        sum(n_tokens) over (partition by domain, lang, source, key) as same, count(*) over (partition by domain, lang, source, key) as n from keyed)
select doc_id, domain, lang, source, n_tokens::bigint as n_tokens, digest, full_epochs::bigint as full_epochs,
    (case when upto <= rest then n_tokens when upto - same < rest then least(n_tokens, (rest - upto + same) // n) else 0 end)::bigint as prefix_tokens,
    (full_epochs * n_tokens + case when upto <= rest then n_tokens when upto - same < rest then least(n_tokens, (rest - upto + same) // n) else 0 end)::bigint as taken_tokens
from ends
"""
