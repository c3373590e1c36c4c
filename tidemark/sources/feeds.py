"""Landed feed documents: item rows, and one outcome per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.aggregates import BATCH, price_usage

#: Date formats of feeds, tried in order.
DATE_FORMATS = ("d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss Z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")

_TEXT = T.StructType([T.StructField("_VALUE", T.StringType())])
_LINK = T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_href", T.StringType()), T.StructField("_rel", T.StringType())])
ENTRY = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("link", T.ArrayType(_LINK)),
        T.StructField("guid", _TEXT),
        T.StructField("id", T.StringType()),
        T.StructField("content:encoded", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("author", T.StructType([T.StructField("name", T.StringType()), T.StructField("_VALUE", T.StringType())])),
        T.StructField("dc:creator", T.StringType()),
        T.StructField("pubDate", T.StringType()),
        T.StructField("published", T.StringType()),
        T.StructField("updated", T.StringType()),
        T.StructField("dc:date", T.StringType()),
        T.StructField("date", T.StringType()),
    ]
)


def _tries(text: Column) -> list[Column]:
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3,9},\s*", "")
    return [F.try_to_timestamp(bare, F.lit(f)) for f in DATE_FORMATS]


def feed_date(*columns: str) -> Column:
    """Seconds of the first of the fields that any format reads; a weekday in front is ignored."""
    return F.unix_timestamp(F.coalesce(*[t for c in columns for t in _tries(F.col(f"`{c}`"))]))


def _present(x: Column) -> Column:
    x = F.trim(x)
    return F.when(x != "", x)


def read_feed_items(spark: SparkSession, path: str) -> DataFrame:
    """``file, external_id, url, title, body, author, published_at`` of all RSS, RDF (``item``) and Atom (``entry``) entries below ``path``.

    Atom's alternate link comes before any other, then an RSS link's text, then guid or id. Entries without a title or an address are dropped;
    unreadable dates are null."""
    out = None
    for tag in ("item", "entry"):
        df = spark.read.format("xml").option("rowTag", tag).option("mode", "PERMISSIVE").schema(ENTRY).load(path)
        alternate = F.get(F.filter("link", lambda x: x["_rel"] == "alternate"), F.lit(0))["_href"]
        any_link = F.get(F.filter("link", lambda x: F.coalesce(x["_href"], x["_VALUE"]).isNotNull()), F.lit(0))
        guid = _present(F.coalesce(F.col("guid._VALUE"), F.col("id")))
        url = F.coalesce(_present(alternate), _present(any_link["_href"]), _present(any_link["_VALUE"]), guid)
        body = F.coalesce(*[_present(F.col(f"`{c}`")) for c in ("content:encoded", "content", "description", "summary")], F.lit(""))
        rows = df.select(
            F.input_file_name().alias("file"), F.coalesce(guid, url).alias("external_id"), url.alias("url"), _present(F.col("title")).alias("title"), body.alias("body"),
            F.coalesce(_present(F.col("`dc:creator`")), _present(F.col("author.name")), _present(F.col("author._VALUE"))).alias("author"), feed_date("pubDate", "published", "updated", "dc:date", "date").alias("published_at"),
        ).where("title is not null and url is not null")
        out = rows if out is None else out.unionByName(rows)
    return out


def classify_feed_documents(docs: DataFrame) -> DataFrame:
    """``path, outcome, n_items, newest_at, warning`` of ``docs(path, body)``: HTML or no root element is ``not_a_feed``; no items is ``empty_feed``, or ``not_a_feed`` when
    the document is also cut off; else ``ok``, with a warning about what follows the end of the root or is missing from it,
    or that it is no well-formed XML. ``newest_at`` is the greatest time of its items (seconds), of each the first of its date fields that can be read; null where none can."""
    body = F.coalesce(F.col("body"), F.lit(""))
    html = F.rlike(body, F.lit(r"(?is)^\s*(?:<!doctype\s+html|<html)"))
    root = F.regexp_extract(body, r"(?is)<(rss|feed|rdf:RDF)\b", 1)
    n = F.regexp_count(body, F.lit(r"(?i)<(?:item|entry)[\s>]")).cast("long")
    closed = F.rlike(body, F.concat(F.lit(r"(?is)</"), root, F.lit(r"\s*>\s*$")))
    broken = F.from_xml(body, "_fault string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_fault"})["_fault"].isNotNull()
    items = F.regexp_extract_all(body, F.lit(r"(?is)<(item|entry)\b.*?</\1\s*>"), F.lit(0))
    field = lambda x, c: F.regexp_extract(x, rf"(?is)<{c}\b[^>]*>\s*(?:<!\[CDATA\[\s*)?([^<\]]*)", 1)
    at = F.array_max(F.transform(items, lambda x: F.unix_timestamp(F.coalesce(*[t for c in ("pubDate", "published", "updated", "dc:date", "date") for t in _tries(field(x, c))]))))
    closed = closed & ~broken
    outcome = F.when(html | (root == ""), "not_a_feed").when(n == 0, F.when(closed, "empty_feed").otherwise("not_a_feed")).otherwise("ok")
    return docs.select("path", outcome.alias("outcome"), F.when(outcome == "ok", n).otherwise(0).alias("n_items"), F.when(outcome == "ok", at).alias("newest_at"), ((outcome == "ok") & ~closed).alias("warning"))


def batch_results(spark: SparkSession, path: str) -> DataFrame:
    """``custom_id, status, verdict, error, model, input_tokens, output_tokens`` of lines of batch results."""
    schema = "custom_id string, result struct<type:string,error:struct<message:string>,message:struct<model:string,content:array<struct<text:string>>,usage:struct<input_tokens:long,output_tokens:long>>>"
    df = spark.read.schema(schema).json(path)
    text = F.get("result.message.content", F.lit(0))["text"]
    parsed = F.when(F.try_parse_json(text).isNotNull(), text)
    status = F.when(F.col("result.type") != "succeeded", F.col("result.type")).when(parsed.isNull(), "invalid_json").otherwise("ok")
    return df.select("custom_id", status.alias("status"), parsed.alias("verdict"), F.col("result.error.message").alias("error"), F.col("result.message.model").alias("model"), F.col("result.message.usage.input_tokens").alias("input_tokens"), F.col("result.message.usage.output_tokens").alias("output_tokens"))


def batch_costs(results: DataFrame, prices: DataFrame) -> DataFrame:
    """``results(custom_id, model, input_tokens, output_tokens, ...)`` with ``cost_micro``: the listed price of the model's longest beginning at half, as batches are; null where no
    price is listed or nothing was used."""
    df = price_usage(results, prices)
    cost = (F.col("input_tokens") * F.col("price_in") + F.col("output_tokens") * F.col("price_out")) * BATCH / 1e6
    return df.withColumn("cost_micro", F.round(cost).cast("long")).drop("priced_as", "price_in", "price_out")


def append_log(df: DataFrame, path: str, date_of: str) -> None:
    """Appends rows to a log, partitioned by the UTC date of an epoch-seconds column."""
    df.withColumn("date", F.to_date(F.timestamp_seconds(date_of))).write.mode("append").partitionBy("date").parquet(path)


def append_analyses(df: DataFrame, analyses: str, ledger: str) -> None:
    """Appends analyses, and a ledger row for each that cost something or used tokens."""
    append_log(df, analyses, "created_at")
    spent = df.where("cost_micro > 0 or cache_read_tokens > 0").select("stage", "model", "cost_micro", "cache_read_tokens", F.col("created_at").alias("spent_at"))
    append_log(spent, ledger, "spent_at")
