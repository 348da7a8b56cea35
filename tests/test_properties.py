"""Property tests: Spark expressions vs Python's own semantics on generated inputs."""

import hashlib
import ipaddress
import random

from hypothesis import given, settings, strategies as st

from netsleuth.functions.hashing import sha_mod
from netsleuth.functions.ip import canonical_ip, ip_to_int, ipv4_to_int

def _generated_addresses(n=3000, seed=2):
    """Valid and broken IPv4/IPv6 texts: random groups, '::' forms, zones,
    embedded and mapped IPv4, leading zeros, out-of-range octets."""
    rnd = random.Random(seed)

    def grp():
        return rnd.choice([format(rnd.randint(0, 0xFFFF), "x"), "0", "0000", "FFFF", "12345", "g"])

    out = ["::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "::1.2.3.4", "::ffff:256.1.1.1", "1.2.3.4::", "fe80::1%eth0"]
    for _ in range(n):
        k = rnd.random()
        if k < 0.25:
            out.append(":".join(grp() for _ in range(rnd.randint(2, 9))))
        elif k < 0.5:
            out.append(":".join(grp() for _ in range(rnd.randint(0, 4))) + "::"
                       + ":".join(grp() for _ in range(rnd.randint(0, 4))))
        elif k < 0.7:
            mask = rnd.choice([0, (1 << 128) - 1, (1 << 64) - 1, ((1 << 16) - 1) << 80, (1 << 48) - 1])
            out.append(str(ipaddress.IPv6Address(rnd.getrandbits(128) & mask)))
        elif k < 0.8:
            out.append(str(ipaddress.IPv6Address((0xFFFF << 32) | rnd.getrandbits(32))))
        else:
            out.append(".".join(rnd.choice([str(rnd.randint(0, 300)), "01", "00", ""])
                                for _ in range(rnd.randint(3, 5))))
    return out


def _py(ip):
    try:
        a = ipaddress.ip_address(ip)
        return str(a), int(a)
    except ValueError:
        return None, 0


def test_ip_text_matches_ipaddress(spark):
    ips = _generated_addresses()
    df = spark.createDataFrame([(v,) for v in ips], "ip string")
    for r in df.select("ip", canonical_ip("ip").alias("c"), ip_to_int("ip").alias("n"),
                       ipv4_to_int("ip").alias("v4")).collect():
        canon, num = _py(r.ip)
        assert r.c == canon, r.ip
        assert r.n == float(num), r.ip
        if canon is not None and ":" not in canon:
            assert r.v4 == num


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(min_size=0, max_size=40), min_size=20, max_size=40),
       st.sampled_from([500_000, 900_000, 7, 2 ** 31 - 1]))
def test_sha_mod_matches_big_integers(spark, texts, modulus):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(sha_mod("t", modulus, 3_000_000)).collect()]
    assert got == [3_000_000 + int(hashlib.sha256(t.encode()).hexdigest(), 16) % modulus for t in texts]
