"""Addresses and networks against the standard library."""

import ipaddress
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievelake.functions import net
from sievelake.operators import predicates as P


def some_addresses():
    rng = random.Random(4)
    v4 = [f"{rng.choice([10, 192])}.{rng.choice([0, 1, 168])}.{rng.randrange(4)}.{rng.randrange(256)}" for _ in range(150)]
    v6 = []
    for _ in range(120):
        high, low = rng.choice([0x20010DB8 << 96, 0xFE80 << 112, 0, 0xFFFF << 32]), rng.getrandbits(rng.choice([8, 20, 64]))
        ip = ipaddress.ip_address(high | low)
        v6.append(rng.choice([str(ip), ip.exploded, str(ip).upper()]))
    odd = [None, "", "10.0.0", "10.0.0.256", "010.0.0.1", "::", "::1", "1::2::3", ":::", "::ffff:10.1.2.3", "::ffff:10.1.2.300", "2001:db8::g", "12345::", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:", "1::2:", "1:2:3:4:5:6:7::", "1:2:3:4::5:6:7:8", "fe80::1%eth0", "64:ff9b::192.0.2.1", "10.0.0.1 "]
    return v4 + v6 + odd + v4[:20]


NETWORKS = ["10.0.0.0/8", "10.1.0.0/16", "10.1.2.0/24", "10.1.2.128/25", "10.1.2.3/32", "192.168.0.0/15", "0.0.0.0/2", "2001:db8::/32", "2001:db8::/61", "fe80::/10", "::/0", "::ffff:10.1.0.0/112", "10.1.9.9/24", "::1/128", "10.1.2.0/24"]


def number(a):
    try:
        ip = ipaddress.ip_address(a)
    except ValueError:
        return None
    if ip.version == 6 and ip.scope_id:
        return None
    return int(ip) + ((0xFFFF << 32) if ip.version == 4 else 0)


def span(cidr):
    n = ipaddress.ip_network(cidr, strict=False)
    return number(str(n[0])), number(str(n[-1])), n.prefixlen + (96 if n.version == 4 else 0)


@pytest.fixture(scope="module")
def addresses(spark):
    return spark.createDataFrame(list(enumerate(some_addresses())), "id long, ip string").cache()


def test_keys(addresses):
    got = {r["ip"]: r["k"] for r in addresses.select("ip", net.ip_key(F.col("ip")).alias("k")).collect()}
    assert got == {a: None if a is None or number(a) is None else f"{number(a):032x}" for a in set(some_addresses())}


@pytest.mark.parametrize("nets", [["10.1.2.0/24"], NETWORKS[:7], ["2001:db8::/32", "10.0.0.0/9"], ["::/0"], ["::ffff:0:0/96"], ["0.0.0.0/0"], ["10.0.0.7/32", "10.0.0.8/31"]])
def test_predicates(addresses, nets):
    want = {i for i, a in enumerate(some_addresses()) if a and (n := number(a)) is not None and any(span(c)[0] <= n <= span(c)[1] for c in nets)}
    assert {r["id"] for r in addresses.filter(P.cidrs("ip", nets)).collect()} == want
    assert {r["id"] for r in addresses.filter(P.none_of(P.cidrs("ip", nets))).collect()} == set(range(len(some_addresses()))) - want
    if len(nets) == 1:
        assert {r["id"] for r in addresses.filter(P.cidr("ip", nets[0])).collect()} == want


def test_join_with_overlapping_networks(spark, addresses):
    table = [(i, c) for i, c in enumerate([*NETWORKS, None, "", "10.0.0.0/33", "10.0.0.0/x", "x/8", "1.2.3.4/5/6", "2001:db8::/129"])]
    nets = spark.createDataFrame(table, "net long, cidr string")
    good = [(i, *span(c)) for i, c in table[: len(NETWORKS)]]
    every, best = set(), set()
    for i, a in enumerate(some_addresses()):
        n = number(a) if a else None
        held = [(bits, -k) for k, low, high, bits in good if n is not None and low <= n <= high]
        every |= {(i, -k) for _, k in held}
        if held:
            bits = max(b for b, _ in held)
            best.add((i, min((table[-k][0], -k) for b, k in held if b == bits)[1]))
    assert {(r["id"], r["net"]) for r in net.join_networks(addresses, "ip", nets, longest=False).collect()} == every
    found = net.join_networks(addresses, "ip", nets)
    assert {(r["id"], r["net"]) for r in found.collect()} == best and found.columns == ["id", "ip", "net", "cidr"]
    left = net.join_networks(addresses, "ip", nets, how="left")
    assert left.count() == len(some_addresses()) and {(r["id"], r["net"]) for r in left.collect() if r["net"] is not None} == best
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty_tables(spark, addresses):
    none = spark.createDataFrame([], "net long, cidr string")
    assert net.join_networks(addresses, "ip", none).count() == 0
    assert net.join_networks(addresses.limit(0), "ip", spark.createDataFrame([(1, "::/0")], "net long, cidr string")).count() == 0


@pytest.mark.parametrize("pack", [2, 512])
def test_networks_of_one_prefix_go_in_packs(spark, monkeypatch, pack):
    """A row meets packs of equal networks, and the plan joins no row for each of them."""
    monkeypatch.setattr(net, "PACK", pack)
    nets = spark.createDataFrame([(i, "10.0.0.0/8" if i % 3 else "10.1.0.0/16") for i in range(30)], "net long, cidr string")
    rows = spark.createDataFrame([(i, f"10.{i % 2}.0.1" if i else None) for i in range(12)], "id long, ip string")
    want = sorted((i, n) for i in range(1, 12) for n in range(30) if n % 3 or i % 2)
    found = net.join_networks(rows, "ip", nets, longest=False)
    assert sorted((r["id"], r["net"]) for r in found.collect()) == want and found.columns == ["id", "ip", "net", "cidr"]
    left = net.join_networks(rows, "ip", nets, longest=False, how="left")
    assert sorted((r["id"], r["net"]) for r in left.filter("id > 0").collect()) == want and left.filter("id = 0 AND net IS NULL").count() == 1
    assert found._jdf.queryExecution().optimizedPlan().toString().lstrip().startswith("Project") and "explode(__nets" in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("panel,slice_,pairs", [(64, 16384, 1 << 22), (2, 16384, 1 << 22), (64, 3, 1 << 22), (2, 5, 8), (1, 1, 1)])
def test_rows_and_packs_meet_once_in_cells(spark, monkeypatch, panel, slice_, pairs):
    """Any slices and panels give each pair once, also of equal rows and equal networks."""
    for name, value in {"PACK": 3, "PANEL": panel, "SLICE": slice_, "PAIRS": pairs}.items():
        monkeypatch.setattr(net, name, value)
    table = [(i // 2, ["10.0.0.0/8", "10.1.0.0/16", "10.1.0.0/30", "fe80::/10"][i % 4]) for i in range(60)]
    held = [(i // 3, [f"10.{i % 2}.0.{i % 5}", "fe80::1", "11.0.0.1", None][i % 4]) for i in range(48)]
    inside = lambda ip, cidr: ip is not None and span(cidr)[0] <= number(ip) <= span(cidr)[1]
    want = [(i, ip, n, c) for i, ip in held for n, c in table if inside(ip, c)]
    alone = [(i, ip, None, None) for i, ip in held if not any(inside(ip, c) for _, c in table)]
    rows, nets = spark.createDataFrame(held, "id long, ip string"), spark.createDataFrame(table, "net long, cidr string")
    assert Counter(map(tuple, net.join_networks(rows, "ip", nets, longest=False).collect())) == Counter(want)
    assert Counter(map(tuple, net.join_networks(rows, "ip", nets, longest=False, how="left").collect())) == Counter(want + alone)


def records_sent(plan) -> int:
    """Records that the exchanges of a plan that ran have written."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return records_sent(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return records_sent(plan.plan())
    own = plan.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
    return own + sum(records_sent(plan.children().apply(i)) for i in range(plan.children().size()))


def test_what_is_sent_does_not_grow_with_the_product(spark, monkeypatch):
    monkeypatch.setattr(net, "PACK", 8)
    nets = spark.createDataFrame([(i, "10.0.0.0/8") for i in range(400)], "net long, cidr string")
    rows = spark.createDataFrame([(i, f"10.0.{i % 7}.1") for i in range(2000)], "id long, ip string")
    found = net.join_networks(rows, "ip", nets, longest=False)
    assert len(found.collect()) == 2000 * 400
    assert 0 < records_sent(found._jdf.queryExecution().executedPlan()) < 4 * (2000 + 400)
