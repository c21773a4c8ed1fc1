"""Addresses against Python's ipaddress."""

import ipaddress
import random

from pyspark.sql import functions as F

from tracewell.functions import enrich


def digits(text):
    try:
        a = ipaddress.ip_address(text)
    except ValueError:
        return None
    return f"{int(a) + (0xFFFF << 32 if a.version == 4 else 0):032x}"


def test_digits(spark):
    rng = random.Random(1)
    texts = ["::", "::1", "1::", "FE80::1", "::ffff:1.2.3.4", "1.2.3.4", "255.255.255.255", "256.1.1.1", "1.2.3", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "1::2::3", ":::", "x", "", "12345::", None]
    texts += [str(ipaddress.IPv6Address(rng.getrandbits(128))) for _ in range(20)] + [str(ipaddress.IPv6Address(rng.getrandbits(16) << rng.randrange(112))) for _ in range(20)] + [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(20)]
    got = [r.d for r in spark.createDataFrame([(t,) for t in texts], "t string").select(enrich.address_digits(F.col("t")).alias("d")).collect()]
    assert got == [None if t is None else digits(t) for t in texts]


def test_ranges(spark):
    rng = random.Random(2)
    edges = sorted(rng.sample(range(1 << 20), 60))
    ranges = [(a, b, f"r{i}") for i, (a, b) in enumerate(zip(edges[0::2], edges[1::2], strict=True))]
    six = lambda n: str(ipaddress.IPv6Address((0x2001 << 112) + (n << 64)))
    asked = [rng.randrange(1 << 20) for _ in range(200)] + edges
    df = spark.createDataFrame([(n, six(n)) for n in asked], "n long, ip string")
    small = spark.createDataFrame([(six(a), six(b), v) for a, b, v in ranges], "lo string, hi string, value string")
    all_ = spark.createDataFrame([("::", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "all")], "lo string, hi string, value string")
    for parts in (1, 7):
        got = enrich.locate(df, "ip", {"small": small, "whole": all_}, ranges=parts).collect()
        assert sorted((r.n, r.small or "", r.whole) for r in got) == sorted((n, next((v for a, b, v in ranges if a <= n <= b), ""), "all") for n in asked)
