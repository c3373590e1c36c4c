"""Registered queries of the text, artifact, entity and web transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import artifacts as G
from .functions import injection as I
from .functions import text as N
from .functions import web as U
from .queries import query
from .operators import addresses as AD
from .operators import items as IT
from .operators import joins as J


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


def _sub(expr: str, pattern: str, new: str = "") -> str:
    return f"regexp_replace({expr}, '{_q(pattern)}', '{new}', 'g')"


@query(
    "n1_sanitize",
    "select page_id, len(regexp_extract_all(html, '(?is)<script\\b[^>]*>.*?</script\\s*>')) as scripts, len(regexp_extract_all(html, '(?is)<style\\b[^>]*>.*?</style\\s*>')) as styles, "
    "len(regexp_extract_all(html, '(?s)<!--.*?(?:-->|$)')) as comments, length(html) as original_length from pages",
)
def _(v):
    return N.sanitize(v("pages"), "html", 2000).select("page_id", "scripts", "styles", "comments", "original_length")


@query("n1_sanitized_text")
def _(v):
    df = N.sanitize(v("pages"), "html", 2000)
    return df.select("page_id", "clean", "truncated", "hidden_elements", "zero_width", "bidi")


def _flag(kind: str) -> str:
    """Does a conversation's turn, with or without its invisible characters, match a pattern of the kind?"""
    return "(" + " or ".join(f"regexp_matches({t}, '{_q(p)}')" for k, p in I.PATTERNS if k == kind for t in ("raw", "visible")) + ")"


_KINDS = sorted({"obfuscation", *(k for k, _ in I.PATTERNS)})


@query(
    "n2_detect_injection",
    f"""with t as (select conv_id, turn, coalesce(text, '') as raw, regexp_replace(coalesce(text, ''), '{I.INVISIBLE}', '', 'g') as visible from conversations)
    select conv_id, turn, array_to_string(list_filter(["""
    + ", ".join(f"case when {'raw <> visible' if k == 'obfuscation' else _flag(k)} then '{k}' end" for k in _KINDS)
    + "], lambda x: x is not null), ',') as kinds from t",
)
def _(v):
    """Every turn; the kind hidden_content counts elements by backreference, which the SQL cannot, and is in the whole query."""
    kinds = F.array_sort(F.array_distinct(F.filter(F.transform("signals", lambda s: s["kind"]), lambda k: k != "hidden_content")))
    return I.detect_injection(v("conversations"), "text").select("conv_id", "turn", F.array_join(kinds, ",").alias("kinds"))


@query("n2_detect_injection_whole")
def _(v):
    """Every turn with all kinds and their evidence."""
    return I.detect_injection(v("conversations"), "text").select("conv_id", "turn", "signals")


def _canonical_sql() -> str:
    names = ", ".join(f"'{n}'" for n in U.TRACKING)
    url = "trim(url)"
    part = lambda i: f"regexp_extract({url}, '{U._URL}', {i})"
    kept = f"list_filter(string_split({part(4)}, '&'), lambda p: p <> '' and split_part(p, '=', 1) not in ({names}) and not starts_with(lower(split_part(p, '=', 1)), 'utm_'))"
    return f"""select page_id, 'https://' || regexp_replace(lower({part(2)}), '^www\\.', '') || (case when length({part(3)}) > 1 then regexp_replace({part(3)}, '/$', '') else '/' end)
      || (case when len({kept}) > 0 then '?' || array_to_string(list_sort({kept}), '&') else '' end) as canonical_url from pages"""


@query("n3_canonicalize_url", _canonical_sql())
def _(v):
    return U.canonicalize_url(v("pages"), "url").select("page_id", "canonical_url")


@query("n4_url_host", f"select page_id, nullif(regexp_replace(lower(regexp_extract(trim(url), '{U._URL}', 2)), '^www\\.', ''), '') as host from pages")
def _(v):
    return v("pages").select("page_id", U.url_host(F.col("url")).alias("host"))


@query("n4_same_canonical_url", "select page_id, page_id % 3 <> 2 or strpos(url, '#') > 0 as same from pages where url is not null union all select page_id, null from pages where url is null")
def _(v):
    added = F.when(F.col("page_id") % 3 == 0, "utm_source=a").when(F.col("page_id") % 3 == 1, "ref=b").otherwise("zz=1")
    variant = F.concat("url", F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), added)
    return U.same_canonical_url(v("pages").withColumn("variant", variant), "url", "variant").select("page_id", "same")


@query("n5_content_hash", "select doc_id, sha256(lower(trim(regexp_replace(coalesce(source, ''), '\\s+', ' ', 'g'))) || chr(10) || lower(trim(regexp_replace(coalesce(lang, ''), '\\s+', ' ', 'g'))) || chr(10) || lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')))) as hash from documents")
def _(v):
    return v("documents").select("doc_id", N.content_hash("source", "lang", "text").alias("hash"))


_VERSIONS = f"array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '{_q(G.VERSION)}'), lambda x: lower(x)))), ',')"


@query("n6_versions", f"select doc_id, {_VERSIONS} as versions from documents")
def _(v):
    return v("documents").select("doc_id", F.array_join(G.versions(F.coalesce("text", F.lit(""))), ",").alias("versions"))


@query("n6_extract_artifacts")
def _(v):
    df = G.extract_artifacts(v("v_items"), "body", "title")
    return df.select("id", *(F.array_join(f"artifacts.{c}", ",").alias(c) for c in ("models", "versions", "repos", "title_models", "title_versions")))


@query("n7_artifact_keys")
def _(v):
    df = G.extract_artifacts(v("v_items"), "body", "title")
    return df.select("id", F.array_join(G.identity_keys(F.col("artifacts")), ",").alias("identity"), F.array_join(G.artifact_keys(F.col("artifacts")), ",").alias("all_keys"))


@query("n8_entities_of_models")
def _(v):
    kinds = F.array(*map(F.lit, ("claude-x", "gpt-4", "o1-mini", "gemini-2", "llama-3", "mixtral-8", "qwen2", "deepseek-v3", "grok-2", "gemma-2", "phi-3", "other")))
    return v("v_items").select("id", F.array_join(G.entities_of_models(F.array(F.get(kinds, (F.col("id") % 12).cast("int")), F.get(kinds, (F.col("id") % 5).cast("int")))), ",").alias("entities"))


@query("n9_normalize_alias", "select doc_id, regexp_replace(lower(source || ' ' || lang), '[^a-z0-9]+', '', 'g') as alias from documents")
def _(v):
    return v("documents").select("doc_id", N.normalize_alias(F.concat_ws(" ", "source", "lang")).alias("alias"))


@query(
    "n10_extract_entities",
    """with w as (select doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') as w from documents where text is not null),
    g as (select distinct doc_id, unnest(list_transform(range(1, len(w) + 1), lambda i: w[i])) as raw from w),
    a(entity_id, normalized) as (values ('art', 'the'), ('con', 'and'), ('det', 'der'), ('fra', 'la')), r(id, rel) as (values ('art', 5), ('con', 4), ('det', 3), ('fra', 2))
    select doc_id, string_agg(id, ',' order by rel desc, id) as entities from (select distinct doc_id, r.id, r.rel from g join a on regexp_replace(lower(raw), '[^a-z0-9]+', '', 'g') = normalized and raw = regexp_replace(raw, '[^\\x00-\\x7F]', '', 'g')
      join r on r.id = a.entity_id) group by doc_id""",
)
def _(v):
    docs = v("documents")
    spark = docs.sparkSession
    aliases = spark.createDataFrame([("art", "the", "the", False), ("con", "and", "and", False), ("det", "der", "der", False), ("fra", "la", "la", False)], "entity_id string, alias string, normalized string, requires_exact_case boolean")
    entities = spark.createDataFrame([("art", 5.0), ("con", 4.0), ("det", 3.0), ("fra", 2.0)], "id string, operator_relevance double")
    found = G.extract_entities(docs, "doc_id", "text", aliases, entities, most=1, normalise=False)
    return found.select("doc_id", F.array_join("entities", ",").alias("entities"))


def _has(p: str) -> str:
    return f"regexp_matches(text, '{_q(p)}')"


@query(
    "n11_infer_category",
    f"""select doc_id, case when {_has(N.POLICY_TERMS)} then 'policy_platform' when {_has(N.HARDWARE_TERMS)} then 'hardware' when {_has(N.SOCIAL_TERMS)} and not {_has(N.AI_TERMS)} then 'social_trend'
      when {_has(N.AI_TERMS)} or source in ('src1', 'src2') then 'ai' else 'software' end as category from documents""",
)
def _(v):
    entities = F.array(F.when(F.col("source").isin("src1", "src2"), "openai").otherwise("x"))
    return v("documents").select("doc_id", N.infer_category(F.col("text"), entities).alias("category"))


def benchmark_registry(v):
    """A registry of multi-word names out of the table ``benchmark``: the first two and the first three words of each passage name its item, the three in exact case
    where the item's number is odd."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
    rows = v("benchmark").select("item_id", words.alias("w")).where("size(w) >= 3")
    grams = F.array(*(F.struct(F.array_join(F.slice("w", 1, n), " ").alias("alias"), ((F.col("item_id") % 2 == 1) & (F.lit(n) == 3)).alias("requires_exact_case")) for n in (2, 3)))
    aliases = rows.select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("entity_id"), F.explode(grams).alias("g")).select("entity_id", "g.alias", N.normalize_alias(F.col("g.alias")).alias("normalized"), "g.requires_exact_case")
    entities = v("benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("id"), (F.col("item_id") % 7).cast("double").alias("operator_relevance"))
    return aliases.where("normalized <> ''").dropDuplicates(["entity_id", "normalized", "requires_exact_case"]), entities


@query("n10_extract_entities_whole")
def _(v):
    """Names of two and three words, whole texts, Unicode folding: brute force in tests/test_items.py."""
    aliases, entities = benchmark_registry(v)
    return G.extract_entities(v("documents"), "doc_id", "text", aliases, entities).select("doc_id", F.array_join("entities", ",").alias("entities"))


@query("n12_normalized_items")
def _(v):
    """Every item with all that it is known by; sources own no entity where their number is odd."""
    aliases, entities = benchmark_registry(v)
    sources = v("v_sources").withColumn("entity", F.when(F.col("n") % 2 == 0, F.concat(F.lit("b"), F.col("n").cast("string"))))
    df = IT.normalize_items(v("v_items"), sources, aliases, entities)
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("signals", lambda s: s["kind"]))), ",")
    return df.select(
        "id", "title", F.md5("summary").alias("summary"), "canonical_url", "content_hash", "source_category", F.array_join("entities", ",").alias("entities"), "category", "occurred_at", "occurred_estimated",
        kinds.alias("signals"), "truncated", F.md5("embedding_text").alias("embedding_text"),
    )


@query("n12_normalize_items")
def _(v):
    items = J.items_with_source(v("v_items"), v("v_sources"), v("v_items").select("id", F.col("id").alias("place"))).select("id", "category")
    df = N.sanitize(v("v_items"), "title", 500).select("id", F.col("clean").alias("title"), "url", "body", "published_at", "fetched_at")
    df = N.sanitize(df, "body", 2000).select("id", "title", F.col("clean").alias("summary"), "url", "published_at", "fetched_at")
    df = U.canonicalize_url(G.extract_artifacts(df.withColumn("both", F.concat_ws("\n", "title", "summary")), "both", "title"), "url")
    df = df.join(items, "id")
    embedded = F.trim(F.concat("title", F.lit("\n\n"), F.substring("summary", 1, 600)))
    return df.select("id", "title", "canonical_url", F.coalesce("published_at", "fetched_at").alias("occurred_at"), F.col("published_at").isNull().alias("estimated"), F.size(G.identity_keys(F.col("artifacts"))).alias("keys"), F.md5(embedded).alias("embedding_text"))


def _redact_sql(expr: str) -> str:
    for p in N.SECRETS:
        expr = _sub(expr, p, N.REDACTED)
    return expr


@query("n13_redact_secrets", f"select doc_id, md5({_redact_sql('text')}) as redacted, {' or '.join(_has(p) for p in N.SECRETS)} as has_secret from documents")
def _(v):
    return v("documents").select("doc_id", F.md5(N.redact_secrets(F.col("text"))).alias("redacted"), N.contains_secret(F.col("text")).alias("has_secret"))


@query("n14_clean_text")
def _(v):
    return v("v_items").select("id", N.clean_text(F.col("body")).alias("clean"))


@query("n15_do_not_say", "select id, contains(lower(body), 'with') and contains(lower(body), 'that') as violates from v_items")
def _(v):
    return v("v_items").select("id", N.violates(F.col("body"), F.array(F.lit("Do not say with that at"), F.lit("short"))).alias("violates"))


@query("n16_factual_number", f"select doc_id, not regexp_matches(text, '{_q(N.YEAR_ONLY)}') and regexp_matches(text, '{_q(N.FACTUAL_NUMBER)}') as factual from documents")
def _(v):
    return v("documents").select("doc_id", N.factual_number(F.col("text")).alias("factual"))


@query("n18_cosine", "select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def _(v):
    e = v("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return e.join(other, "vec_id").select("vec_id", F.round(N.cosine(F.col("a"), F.col("b")), 6).alias("cosine"))


@query("n19_repo_of_feed", "select page_id, 'own' || page_id::varchar || '/repo' as repo from pages")
def _(v):
    url = F.concat(F.lit("https://github.com/own"), F.col("page_id").cast("string"), F.lit("/repo/releases.atom"))
    return v("pages").select("page_id", N.repo_of_feed(url).alias("repo"))


def _blocked_sql(n: str) -> str:
    first = lambda a: sum(int(x) << 8 * (3 - i) for i, x in enumerate(a.split(".")))
    return " or ".join(f"{n} between {first(a)} and {first(a) + (1 << 32 - bits) - 1}" for a, bits in U.BLOCKED_V4)


_HOST = f"nullif(regexp_replace(lower(regexp_extract(trim(url), '{U._URL}', 2)), '^www\\.', ''), '')"


@query(
    "n20_fetchable_urls",
    f"""with h as (select page_id, {_HOST} as host from pages), a as (select page_id, host, ('0x' || substr(md5(host), 1, 8))::bigint as n from h where host is not null)
    select page_id from a where host in (select host from a group by host having count(*) >= 2) and not ({_blocked_sql("n")})""",
)
def _(v):
    """Hosts of several pages may be fetched; the first four bytes of a host's MD5 stand for the address that it resolves to."""
    hosts = v("pages").select("page_id", U.url_host(F.col("url")).alias("host")).where("host is not null")
    byte = lambda i: F.conv(F.substring(F.md5("host"), 1 + 2 * i, 2), 16, 10)
    resolved = hosts.select("host").distinct().select("host", F.concat_ws(".", *map(byte, range(4))).alias("address"))
    allowed = hosts.groupBy("host").count().where("count >= 2")
    return AD.fetchable_urls(v("pages"), allowed, resolved=resolved).select("page_id")


@query(
    "n20_page_ranges",
    f"""with a as (select distinct ('0x' || substr(md5(url), 1, 8))::bigint as n from pages), r as (select (('0x' || substr(md5(cast(item_id as varchar)), 1, 8))::bigint >> (32 - l)) as p, l from (select item_id, 4 + item_id % 21 as l from benchmark) x)
    select n, max(l) as bits from a join r on (a.n >> (32 - r.l)) = r.p group by n""",
)
def _(v):
    """Addresses of all pages in a table of ranges of 21 lengths: the narrowest one."""
    dotted = lambda c: F.concat_ws(".", *(F.conv(F.substring(F.md5(c), 1 + 2 * i, 2), 16, 10) for i in range(4)))
    ranges = v("benchmark").select(F.concat(dotted(F.col("item_id").cast("string")), F.lit("/"), (4 + F.col("item_id") % 21).cast("string")).alias("cidr"))
    found = AD.ranges_of(v("pages").select(dotted(F.col("url")).alias("address")), ranges)
    return found.select(U.ip_number(F.col("address")).alias("n"), F.substring_index("cidr", "/", -1).cast("long").alias("bits"))


@query("n21_robots_allowed")
def _(v):
    hosts = v("pages").select(U.url_host(F.col("url")).alias("host"), F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1).alias("path")).distinct()
    files = hosts.select("host").distinct().withColumn("robots", F.lit("User-agent: a\nUser-agent: *\nDisallow: /en/\nAllow: /en/1\n\nUser-agent: b\nDisallow: /*9$"))
    return U.robots_allowed(hosts, U.robots_rules(files), "a")


@query("n22_age_bucket", "select id, case when h < 1 then 'under an hour' when h < 6 then 'same morning' when h < 24 then 'same day' else 'days' end as bucket from (select id, (fetched_at - published_at) / 3600 as h from v_items where published_at is not null)")
def _(v):
    return v("v_items").where("published_at is not null").select("id", N.age_bucket((F.col("fetched_at") - F.col("published_at")) / 3600).alias("bucket"))


@query("n23_moved_sources", "select page_id as source_id from pages where page_id % 5 = 0")
def _(v):
    final = F.when(F.col("page_id") % 5 == 0, "https://moved.example.net/").otherwise(F.upper("url"))
    return U.moved_sources(v("pages").select(F.col("page_id").alias("source_id"), "url", final.alias("final_url"))).select("source_id")


_ORIGIN = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"


@query(
    "s3_discover_links",
    f"""with h as (select page_id, {_ORIGIN} as o, unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"'']+)["''][^>]*>', 1)) as href from pages),
    p as (select page_id, o, regexp_extract(href, '^(/[^?#]*)', 1) as path from h where starts_with(href, '/'))
    select distinct page_id, o || path as link, trim(regexp_replace(regexp_extract(path, '([^/]+)/?$', 1), '[-_]+', ' ', 'g')) as title from p where regexp_matches(path, '(?i)^/[a-z0-9][a-z0-9-]*/?$')""",
)
def _(v):
    return U.discover_links(v("pages"), r"(?i)^/[a-z0-9][a-z0-9-]*/?$")


_PAGE_TEXT = "trim(" + _sub(_sub(_sub(_sub(_sub(_sub("html", r"(?is)<script\b[^>]*>.*?</script>", " "), r"(?is)<style\b[^>]*>.*?</style>", " "), r"(?s)<!--.*?-->", " "), r"<[^>]+>", " "), "(?i)&nbsp;", " "), r"\s+", " ") + ")"


@query("s4_page_snapshot_changes", f"select page_id, 'page:' || sha256({_PAGE_TEXT}) as page_hash from pages where page_id % 3 <> 0")
def _(v):
    pages = v("pages")
    seen = U.page_snapshot_changes(pages.where("page_id % 3 = 0"), pages.sparkSession.createDataFrame([], "page_id long, page_hash string"))
    return U.page_snapshot_changes(pages, seen)
