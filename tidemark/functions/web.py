"""Addresses and pages: canonical URLs, link discovery, snapshots, fetch guards, robots rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Query parameters that only track, hosts that wrap another address, and the parameters that hold it.
TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_name", "utm_reader", "utm_brand", "utm_social", "utm_social-type",
    "ref", "referer", "referrer", "source", "src", "fbclid", "gclid", "dclid", "gbraid", "wbraid", "msclkid", "twclid", "igshid", "mc_cid", "mc_eid", "yclid",
    "_hsenc", "_hsmi", "hsCtaTracking", "vero_conv", "vero_id", "wt_zmc", "at_medium", "at_campaign", "oly_anon_id", "oly_enc_id", "spm", "share", "sharetype",
    "trk", "trkCampaign", "cmpid", "campaign_id", "CMP", "ncid", "sr_share", "guccounter", "guce_referrer", "guce_referrer_sig",
)
WRAPPERS = ("feedproxy.google.com", "news.google.com", "out.reddit.com", "t.co", "lnkd.in", "href.li")
WRAPPED_IN = ("url", "u", "q", "target")

# Address ranges that are never fetched (network, prefix length), and beginnings of such IPv6 addresses.
BLOCKED_V4 = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24),
    ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)
BLOCKED_V6 = r"^(?:::1?$|f[cd]|fe[89ab]|ff)"

#: Fixed value: paths of articles on a listing page.
ARTICLE_PATH = r"(?i)^/(?:news|blog|posts|research|engineering)/[a-z0-9][a-z0-9-]*/?$"

_URL = r"(?is)^\s*(https?)://(?:[^/?#@]*@)?([^/?#:@]+)(?::[0-9]*)?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, _URL, i)


def url_host(url: Column) -> Column:
    """Lower-case host without ``www.``; null if the address is not HTTP(S)."""
    host = F.regexp_replace(F.lower(F.trim(_part(url, 2))), r"^www\.", "")
    return F.when(host != "", host)


def _unwrapped(url: Column) -> Column:
    host = F.lower(_part(url, 2))
    query = F.concat(F.lit("&"), _part(url, 4))
    found = F.lit(None).cast("string")
    for name in reversed(WRAPPED_IN):
        value = F.try_url_decode(F.regexp_extract(query, rf"&{name}=([^&]*)", 1)) if hasattr(F, "try_url_decode") else F.url_decode(F.regexp_extract(query, rf"&{name}=([^&]*)", 1))
        found = F.when(F.rlike(value, F.lit("(?i)^https?://")), value).otherwise(found)
    return F.when(host.isin(*WRAPPERS), F.coalesce(found, url)).otherwise(url)


def canonicalize_url(df: DataFrame, column: str, out: str = "canonical_url", unwrap: int = 3) -> DataFrame:
    """Adds the canonical form: https, lower-case host without ``www.``, port, user and fragment; no tracking parameters, the
    others sorted by name; no trailing slash; wrapped addresses up to ``unwrap`` levels deep. What is not HTTP(S) is only trimmed."""
    df = df.withColumn("_u", F.trim(F.col(column)))
    for _ in range(unwrap):
        df = df.withColumn("_u", _unwrapped(F.col("_u")))
    u = F.col("_u")
    name = lambda p: F.get(F.split(p, "=", 2), F.lit(0))
    kept = F.filter(F.split(_part(u, 4), "&"), lambda p: (p != "") & ~name(p).isin(*TRACKING) & ~F.startswith(F.lower(name(p)), F.lit("utm_")))
    ordered = F.transform(F.array_sort(F.transform(kept, lambda p, i: F.struct(name(p).alias("k"), i.alias("i"), p.alias("p")))), lambda x: x["p"])
    query = F.array_join(ordered, "&")
    path = F.when(_part(u, 3) == "", "/").otherwise(_part(u, 3))
    path = F.when(F.length(path) > 1, F.regexp_replace(path, "/$", "")).otherwise(path)
    built = F.concat(F.lit("https://"), url_host(u), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return df.withColumn(out, F.coalesce(built, u)).drop("_u")


def same_canonical_url(df: DataFrame, a: str, b: str, out: str = "same") -> DataFrame:
    """Adds whether two addresses have one canonical form; null if one is null."""
    df = canonicalize_url(canonicalize_url(df, a, "_canonical_a"), b, "_canonical_b")
    return df.withColumn(out, F.col("_canonical_a") == F.col("_canonical_b")).drop("_canonical_a", "_canonical_b")


def page_text(html: Column) -> Column:
    text = F.coalesce(html, F.lit(""))
    for pattern in (r"(?is)<script\b[^>]*>.*?</script>", r"(?is)<style\b[^>]*>.*?</style>", r"(?s)<!--.*?-->", r"<[^>]+>", r"(?i)&nbsp;"):
        text = F.regexp_replace(text, pattern, " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def discover_links(pages: DataFrame, pattern: str = ARTICLE_PATH) -> DataFrame:
    """``page_id, link, title``: distinct same-origin links whose path matches, without query and fragment; title from the last path segment."""
    origin = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    hrefs = F.regexp_extract_all("html", F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"']+)["'][^>]*>"""), 1)
    df = pages.select("page_id", origin.alias("origin"), F.explode(hrefs).alias("href"))
    absolute = F.when(F.rlike("href", F.lit("(?i)^https?://")), F.col("href")).when(F.startswith("href", F.lit("/")), F.concat("origin", "href"))
    df = df.withColumn("absolute", absolute).where("absolute is not null")
    path = F.regexp_extract("absolute", r"^https?://[^/?#]+([^?#]*)", 1)
    df = df.withColumn("path", path).where((F.regexp_extract("absolute", r"^(https?://[^/?#]+)", 1) == F.col("origin")) & F.rlike("path", F.lit(pattern)))
    title = F.trim(F.regexp_replace(F.regexp_extract("path", r"([^/]+)/?$", 1), "[-_]+", " "))
    return df.select("page_id", F.concat("origin", "path").alias("link"), title.alias("title")).distinct()


def page_snapshot_changes(pages: DataFrame, seen: DataFrame) -> DataFrame:
    """``page_id, page_hash``: pages whose text's hash is new for the page; ``seen(page_id, page_hash)``."""
    hashed = pages.select("page_id", F.concat(F.lit("page:"), F.sha2(page_text(F.col("html")), 256)).alias("page_hash"))
    return hashed.join(seen, ["page_id", "page_hash"], "left_anti")


def ip_number(address: Column) -> Column:
    """The number of an IPv4 address, null if it is none."""
    parts = F.split(address, r"\.")
    ok = F.rlike(address, F.lit(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$")) & F.forall(parts, lambda p: F.expr("true") & (p.try_cast("int") <= 255))
    return F.when(ok, F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p.cast("long")))


def _v4(text: str) -> int:
    a, b, c, d = map(int, text.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def blocked(host: Column) -> Column:
    """Is a literal address in a blocked range? Names are not literal addresses."""
    n = ip_number(host)
    inside = F.lit(False)
    for network, prefix in BLOCKED_V4:
        first = _v4(network)
        inside = inside | n.between(first, first + 2 ** (32 - prefix) - 1)
    v6 = F.contains(host, F.lit(":")) & F.rlike(F.lower(host), F.lit(BLOCKED_V6))
    return F.coalesce(inside, F.lit(False)) | v6


def robots_rules(files: DataFrame) -> DataFrame:
    """``host, agent, allow, rule, pattern`` of ``files(host, robots)``. Consecutive user-agent lines share the rules that follow."""
    from pyspark.sql.window import Window

    lines = files.select("host", F.posexplode(F.split("robots", r"\r?\n")).alias("line", "raw"))
    text = F.trim(F.regexp_replace("raw", "#.*$", ""))
    field, value = F.lower(F.trim(F.regexp_extract(text, r"^([A-Za-z-]+)\s*:", 1))), F.trim(F.regexp_extract(text, r"^[A-Za-z-]+\s*:(.*)$", 1))
    w = Window.partitionBy("host").orderBy("line")
    rows = lines.select("host", "line", field.alias("field"), value.alias("value")).where("field in ('user-agent', 'allow', 'disallow')")
    starts = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(w), F.lit("")) != "user-agent")
    rows = rows.withColumn("group", F.sum(F.when(starts, 1).otherwise(0)).over(w))
    agents = rows.where("field = 'user-agent'").select("host", "group", F.lower("value").alias("agent"))
    rules = rows.where("field <> 'user-agent' and value <> ''").select("host", "group", (F.col("field") == "allow").alias("allow"), F.col("value").alias("rule"))
    return agents.join(rules, ["host", "group"]).drop("group")


def robots_allowed(urls: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """``urls(host, path)`` with ``allowed``: the longest matching rule of the agent's group (else of ``*``) decides, allow wins ties."""
    named = rules.groupBy("host").agg(F.max(F.col("agent") == agent.lower()).alias("named"))
    mine = rules.join(named, "host").where(F.when(F.col("named"), F.col("agent") == agent.lower()).otherwise(F.col("agent") == "*"))
    literal = F.regexp_replace("rule", r"([.+?^{}()|\[\]\\])", r"\\$1")
    anchored = F.endswith("rule", F.lit("$"))
    body = F.replace(F.when(anchored, F.expr("substr(r, 1, length(r) - 1)")).otherwise(F.col("r")), F.lit("*"), F.lit(".*"))
    mine = mine.withColumn("r", literal).withColumn("pattern", F.concat(F.lit("^"), body, F.when(anchored, "$").otherwise("")))
    hits = urls.join(mine.select("host", "pattern", "rule", "allow"), "host").where(F.rlike("path", F.col("pattern")))
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("l"), "allow"))["allow"].alias("allow"))
    return urls.join(best, ["host", "path"], "left").select("host", "path", F.coalesce("allow", F.lit(True)).alias("allowed"))


def moved_sources(outcomes: DataFrame) -> DataFrame:
    """``outcomes(source_id, url, final_url)`` whose final host differs from the registered one."""
    df = outcomes.select("source_id", url_host(F.col("url")).alias("host"), url_host(F.col("final_url")).alias("final_host"))
    return df.where("host <> final_host")
