"""Addresses and ranges against the standard library."""

import ipaddress

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import addresses


def random_addresses(n, seed=4):
    rng = np.random.default_rng(seed)
    for _ in range(n):
        if rng.random() < 0.5:
            yield str(ipaddress.IPv4Address(int(rng.integers(0, 1 << 32))))
        else:
            x = int.from_bytes(rng.bytes(16), "big") & int.from_bytes(rng.choice([0, 255], 16).astype(np.uint8).tobytes(), "big")
            a = ipaddress.IPv6Address(x)
            yield str(a) if rng.random() < 0.6 else a.exploded.upper()


ODD = ["::", "::1", "1::", "[fe80::1%eth0]", "::ffff:10.0.0.1", "::FFFF:8.8.8.8", "64:ff9b::1.2.3.4", "fe80::", "example.com", "", "1.2.3", "1.2.3.256", ":::", "1:2:3:4:5:6:7", "1::2::3", "12345::", "1:2:3:4:5:6:7:8:9", ":1:2:3:4:5:6:7", "g::1", None]


def parsed(text):
    try:
        a = ipaddress.ip_address(text.strip("[]").split("%")[0])
    except (ValueError, AttributeError):
        return None
    return a.ipv4_mapped if a.version == 6 and a.ipv4_mapped else a


def test_bits(spark):
    cases = [*random_addresses(300), *ODD]
    got = addresses.with_bits(spark.createDataFrame([(x,) for x in cases], "a string"), "a").collect()
    for r in got:
        a = parsed(r["a"])
        assert r["bits"] == (None if a is None else f"{int(a):0{a.max_prefixlen}b}"), r


def test_narrowest_range(spark):
    rng, cases = np.random.default_rng(9), [*random_addresses(400, 5), *ODD]
    cidrs = {str(ipaddress.ip_network((int(parsed(x)) >> s << s, parsed(x).max_prefixlen - s)) if parsed(x).version == 4 else ipaddress.IPv6Network((int(parsed(x)) >> s << s, 128 - s))) for x in random_addresses(300, 5) for s in [int(rng.integers(0, 33))]}
    cidrs |= {"0.0.0.0/2", "8000::/1", "10.0.0.0/8"}
    networks = [ipaddress.ip_network(c) for c in cidrs]
    want = {}
    for x in cases:
        a = parsed(x)
        hits = [n for n in networks if a is not None and n.version == a.version and a in n]
        if hits:
            want[x] = str(max(hits, key=lambda n: n.prefixlen))
    ranges = spark.createDataFrame([(c,) for c in [*cidrs, "nonsense", "1.2.3.4/40", "1.2.3.4/x"]], "cidr string")
    got = addresses.ranges_of(spark.createDataFrame([(x,) for x in [*cases, *cases]], "address string"), ranges).collect()
    assert {r["address"]: r["cidr"] for r in got} == want and len(got) == len(want) > 300
    assert addresses.ranges_of(spark.createDataFrame([("1.2.3.4",)], "address string"), ranges.limit(0)).count() == 0


def test_fetchable(spark):
    urls = ["https://a.example/x", "http://10.1.2.3/", "http://8.8.8.8/", "http://[::1]:80/", "http://[2001:db8::1]/y", "https://b.example/", "https://c.example/", "ftp://a.example/", None]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    allowed = df.select(addresses.literal_host(F.col("url")).alias("host")).where("host is not null and host <> 'c.example'")
    resolved = spark.createDataFrame([("a.example", "1.1.1.1"), ("a.example", "2600::1"), ("b.example", "1.1.1.1"), ("b.example", "::ffff:192.168.0.9")], "host string, address string")
    got = lambda **k: {r["url"] for r in addresses.fetchable_urls(df, allowed, **k).collect()}
    assert got() == {"https://a.example/x", "http://8.8.8.8/", "http://[2001:db8::1]/y", "https://b.example/"}
    assert got(resolved=resolved) == {"https://a.example/x", "http://8.8.8.8/", "http://[2001:db8::1]/y"}
    assert got(ranges=spark.createDataFrame([("8.0.0.0/8",)], "cidr string")) == set(urls[:2]) | {"http://[::1]:80/", "http://[2001:db8::1]/y", "https://b.example/"}
    assert got(resolved=spark.createDataFrame([("a.example", "not an address")], resolved.schema)) == {"http://8.8.8.8/", "http://[2001:db8::1]/y", "https://b.example/"}
