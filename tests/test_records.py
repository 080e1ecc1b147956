import csv
import io
import ipaddress
import random
import uuid

import pytest
from pyspark.sql import functions as F

from ripplegraph.functions import addresses, config, records


def test_records_round_trip(spark):
    rng = random.Random(3)
    texts, want = [], []
    for _ in range(200):
        width = rng.randint(1, 4)
        field = lambda: "".join(rng.choice(["a", "é", " ", ",", '"', "\n", "x"]) for _ in range(rng.randint(0, 6)))
        rows = [[f"k{i}" for i in range(width)]] + [[field() for _ in range(width)] for _ in range(rng.randint(0, 5))]
        rows = [r if width > 1 or r[0] else ["y"] for r in rows]
        out = io.StringIO()
        csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"]), quoting=rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL])).writerows(rows)
        texts.append(out.getvalue() if rng.random() < 0.5 else out.getvalue().rstrip("\r\n") if not rows[-1][-1].endswith("\n") else out.getvalue())
        want.append([dict(zip(rows[0], r, strict=True)) for r in rows[1:]])
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    assert [r[0] for r in df.orderBy("id").select(records.csvdecode(F.col("t"))).collect()] == want


def test_problems_of_records(spark):
    cases = {
        "": "missing header", "\n\n": "missing header", "a\n\n1\n": None, 'a,b\n1\n': "wrong number of fields", "a,a\n1,2": "repeated column name", 'a\nx"y\n': "bad quotes", 'a\n"x"y\n': "bad quotes",
        'a\n"x': "bad quotes", 'a\n "x"\n': "bad quotes", 'a,b\r\n"1\r\n2",\r\n': None, 'a\n""\n': None, ",b\n1,2": None, None: None,
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.p for r in df.select("t", records.parsed(F.col("t"))["problem"].alias("p")).collect()} == cases
    with pytest.raises(Exception, match="bad records: wrong number"):
        df.where("t like 'a,b_1_'").select(records.csvdecode(F.col("t"))).collect()
    long = 'a,b\n"' + 'x""' * 300_000 + '",' + "y" * 500_000 + "\n"
    late = ["a\nx" + "y" * 1_000_000 + '"\n', 'a\n"' + "y" * 1_000_000, "a\n" + 'x"' * 500_000 + "\n"]
    assert {r[0] for r in spark.createDataFrame([(t,) for t in late], "t string").select(records.parsed(F.col("t"))["problem"]).collect()} == {"bad quotes"}
    one = spark.createDataFrame([(long,)], "t string").select(records.csvdecode(F.col("t"))[0].alias("m")).select(F.length(F.col("m")["a"]), F.length(F.col("m")["b"])).first()
    assert tuple(one) == (600_000, 500_000)


def test_addresses_equal_a_slow_version(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(300):
        v4 = rng.random() < 0.4
        size = 32 if v4 else 128
        raw = rng.getrandbits(size) & rng.choice([-1, rng.getrandbits(size), ~(((1 << 64) - 1) << rng.randint(0, 64))]) & ((1 << size) - 1)
        text = str(ipaddress.IPv4Address(raw) if v4 else ipaddress.IPv6Address(raw))
        length = rng.randint(0, size)
        hosts = size - length
        n = rng.randrange(1 << min(hosts, 62))
        rows.append((f"{text}/{length}", n if rng.random() < 0.6 else -1 - n))
    df = spark.createDataFrame(rows, "x string, n long")
    part = F.when(F.col("n") < 0, -F.col("n")).otherwise(F.col("n")) % 8
    got = df.select("x", "n", addresses.cidrhost(F.col("x"), F.col("n")).alias("host"), addresses.cidrnetmask(F.col("x")).alias("mask")).collect()
    for x, n, host, mask in got:
        net = ipaddress.ip_network(x, strict=False)
        assert (host, mask) == (str(net[n]), str(net.netmask)), (x, n)
    fits = df.where(F.regexp_extract("x", r"/(\d+)$", 1).cast("int") <= 29)
    for x, k, cut in fits.select("x", part, addresses.cidrsubnet(F.col("x"), 3, part)).collect():
        net = ipaddress.ip_network(x, strict=False)
        size = net.prefixlen + 3
        assert cut == f"{ipaddress.ip_address(int(net.network_address) + (k << (net.max_prefixlen - size))) if net.version == 4 else ipaddress.IPv6Address(int(net.network_address) + (k << (net.max_prefixlen - size)))}/{size}"


def test_addresses_by_cases(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(config.cidrsubnets(F.lit("10.1.0.0/16"), 4, 4, 8, 4)) == ["10.1.0.0/20", "10.1.16.0/20", "10.1.32.0/24", "10.1.48.0/20"]
    assert get(config.cidrsubnets(F.lit("fd00:fd12:3456:7890::/56"), 16, 16, 16, 32)) == ["fd00:fd12:3456:7800::/72", "fd00:fd12:3456:7800:100::/72", "fd00:fd12:3456:7800:200::/72", "fd00:fd12:3456:7800:300::/88"]
    assert get(addresses.cidrhost(F.lit("::ffff:10.0.0.0/112"), 258)) == "::ffff:a00:102" and get(addresses.cidrhost(F.lit(None).cast("string"), 1)) is None
    with pytest.raises(ValueError, match="no room"):
        config.cidrsubnets(F.lit("10.0.0.0/8"), 1, 1, 1)
    for bad in ("10.0.0/8", "10.0.0.256/8", "10.0.0.0", "10.0.0.0/33", "1::2::3/8", "1:2:3:4:5:6:7/8", "::1/129", "12345::/3", "01.0.0.0/8", "", "/8", ":::/3"):
        with pytest.raises(Exception, match="bad address range"):
            get(addresses.cidrnetmask(F.lit(bad)))
    for c in (addresses.cidrhost(F.lit("10.0.0.0/24"), 256), addresses.cidrhost(F.lit("10.0.0.0/24"), -257), addresses.cidrsubnet(F.lit("10.0.0.0/24"), 2, 4), addresses.cidrsubnet(F.lit("10.0.0.0/24"), 9, 0)):
        with pytest.raises(Exception, match="no such"):
            get(c)
    for name in ("", "x.test", "é"):
        assert get(addresses.uuidv5("dns", F.lit(name))) == str(uuid.uuid5(uuid.NAMESPACE_DNS, name)) and get(config.uuidv5(str(uuid.NAMESPACE_X500), F.lit(name))) == str(uuid.uuid5(uuid.NAMESPACE_X500, name))
