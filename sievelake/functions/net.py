"""IP addresses as sortable keys, and networks as key ranges.

A key is the address as 32 hexadecimal digits (IPv4 mapped into IPv6), so that
order of keys is order of addresses and a network is one range of keys.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

V4 = r"^((25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])$"
TAIL = r"^([0-9a-fA-F:]*:)" + f"({V4[1:-1]})$"
_PREFIX = "0" * 20 + "ffff"


def key_of(address: str) -> str:
    """The key of a literal address; raises on a bad one."""
    ip = ipaddress.ip_address(address.strip())
    return f"{_PREFIX}{int(ip):08x}" if ip.version == 4 else f"{int(ip):032x}"


def network_range(cidr: str) -> tuple[str, str]:
    """First and last key of a network."""
    net = ipaddress.ip_network(cidr.strip(), strict=False)
    return key_of(str(net[0])), key_of(str(net[-1]))


def merged_ranges(cidrs: list[str]) -> list[tuple[str, str]]:
    """Ranges of several networks, overlapping ones merged."""
    out: list[tuple[str, str]] = []
    for low, high in sorted(network_range(c) for c in cidrs):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _number(address: Column) -> Column:
    """A plain IPv4 address as a number."""
    octets = F.split(address, r"\.")
    part = lambda i: octets[i].try_cast("long")
    return part(0) * (1 << 24) + part(1) * (1 << 16) + part(2) * (1 << 8) + part(3)


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _v6_key(address: Column) -> Column:
    """Key of an address with colons; null where it is none."""

    def parsed(halves: Column) -> Column:
        groups = lambda half: F.filter(F.split(half, ":"), lambda g: g != "")
        left = groups(halves[0])
        right = F.when(F.size(halves) > 1, groups(F.get(halves, F.lit(1)))).otherwise(F.array().cast("array<string>"))
        # "::" stands for one group at least, and nothing else does
        fill = F.when(F.size(halves) > 1, F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - F.size(left) - F.size(right), F.lit(1)))).otherwise(F.array().cast("array<string>"))
        return _bound(F.concat(left, fill, right), lambda g: F.when((F.size(g) == 8) & F.forall(g, lambda x: F.length(x) <= 4), F.array_join(F.transform(g, lambda x: F.lpad(x, 4, "0")), "")))

    def read(a: Column) -> Column:
        good = a.rlike("^[0-9a-f:]+$") & ~a.rlike("::.*::|:::|^:[^:]|[^:]:$")
        return F.when(good, _bound(F.split(a, "::", 2), parsed))

    tail = F.regexp_extract(address, TAIL, 2)
    octets = F.split(tail, r"\.")
    pair = lambda i: F.hex(octets[i].try_cast("int") * 256 + octets[i + 1].try_cast("int"))
    plain = F.when(address.contains("."), F.when(address.rlike(TAIL), F.concat(F.regexp_extract(address, TAIL, 1), pair(0), F.lit(":"), pair(2)))).otherwise(address)
    return _bound(F.lower(plain), read)


def ip_key(address: Column) -> Column:
    """Key of an address column; null where it is no address.

    An IPv6 address may end in an IPv4 one (``::ffff:1.2.3.4``).  The common plain
    IPv4 form is tried first and costs nothing of the other.
    """
    v4 = F.concat(F.lit(_PREFIX), F.lpad(F.lower(F.hex(_number(address))), 8, "0"))
    return F.when(address.rlike(V4), v4).when(address.contains(":"), _v6_key(address))


def _v4_prefixes(ranges: list[tuple[str, str]]) -> dict[int, list[int]]:
    """What the ranges hold of IPv4, as prefixes by the number of bits after them."""
    low, high = int(_PREFIX + "0" * 8, 16), int(_PREFIX + "f" * 8, 16)
    out: dict[int, list[int]] = {}
    for a, b in ranges:
        first, last = max(int(a, 16), low), min(int(b, 16), high)
        if first <= last:
            for net in ipaddress.summarize_address_range(ipaddress.IPv4Address(first - low), ipaddress.IPv4Address(last - low)):
                out.setdefault(32 - net.prefixlen, []).append(int(net[0]) >> (32 - net.prefixlen))
    return out


def in_ranges(address: Column, ranges: list[tuple[str, str]]) -> Column:
    """Whether an address lies in one of the key ranges; false where it is none.

    Plain IPv4 addresses are looked up as numbers, in one set for each length of
    prefix; only others make a key, and that once.
    """
    number, v4 = _number(address), F.lit(False)
    for bits, prefixes in sorted(_v4_prefixes(ranges).items()):
        v4 = v4 | (F.shiftright(number, bits).isin(*prefixes) if bits < 32 else F.lit(True))

    def test(key: Column) -> Column:
        found = F.lit(False)
        for low, high in ranges:
            found = found | key.between(low, high)
        return F.coalesce(found, F.lit(False))

    v6 = F.exists(F.array(_v6_key(address)), test)
    return F.coalesce(F.when(address.rlike(V4), v4).when(address.contains(":"), v6), F.lit(False))


def in_networks(address: Column, cidrs: list[str]) -> Column:
    """Whether an address lies in one of the networks; false where it is none."""
    return in_ranges(address, merged_ranges(cidrs))


# ---- tables of networks --------------------------------------------------------

_NIBBLES = "0123456789abcdef"
#: Networks of one prefix that go together, about.
PACK = 512
#: Packs of a panel, rows of a slice at most, about, and pairs for which a further slice is made.
PANEL, SLICE, PAIRS = 64, 16_384, 1 << 16


def prefix_of(key: Column, bits: int) -> Column:
    """The first ``bits`` of a key, as digits."""
    whole, rest = divmod(bits, 4)
    if not rest:
        return F.substring(key, 1, whole)
    kept = "".join(_NIBBLES[i & (15 << (4 - rest)) & 15] for i in range(16))
    return F.concat(F.substring(key, 1, whole), F.translate(F.substring(key, whole + 1, 1), _NIBBLES, kept))


def networks_of(cidr: Column) -> tuple[Column, Column]:
    """(key, bits) of a column of networks; bits null where it is none.  Bits count
    in IPv6; an address alone is a network of one."""
    key = ip_key(F.trim(F.split(cidr, "/")[0]))
    given = F.get(F.split(cidr, "/"), F.lit(1))
    plain = F.trim(F.split(cidr, "/")[0]).rlike(V4)
    bits = F.when(F.size(F.split(cidr, "/")) == 1, F.lit(128)).when((F.size(F.split(cidr, "/")) == 2) & given.rlike("^[0-9]{1,3}$"), given.cast("int") + F.when(plain, 96).otherwise(0))
    return key, F.when(key.isNotNull() & (bits <= 128), bits)


def join_networks(df: DataFrame, address: str, networks: DataFrame, cidr: str = "cidr", longest: bool = True, how: str = "inner") -> DataFrame:
    """Rows of ``df`` with the columns of the network that their address lies in:
    the one of the longest prefix, or with ``longest=False`` each of them.

    Networks may overlap and be many: an address is looked up by its prefix of
    every length that the table of networks has (at most 129), an equi-join that
    Spark plans by size.  Each address is looked up once, however many rows have
    it.  Of equal networks the one least by its columns is taken.  Rows whose
    address is none, and networks that are none, meet nothing.
    """
    key, bits = networks_of(F.col(cidr))
    held = networks.select(F.struct(*[F.col(f"`{c}`") for c in networks.columns]).alias("__net"), key.alias("__key"), bits.alias("__bits")).filter("__bits IS NOT NULL")
    lengths = sorted(r[0] for r in held.select("__bits").distinct().collect())  # at most 129
    prefix = F.lit(None).cast("string")
    for n in lengths:
        prefix = F.when(F.col("__bits") == n, prefix_of(F.col("__key"), n)).otherwise(prefix)
    table = held.select("__net", "__bits", prefix.alias("__prefix"))
    if longest:
        table = table.groupBy("__bits", "__prefix").agg(F.min("__net").alias("__net"))
    own = df.groupBy(F.col(address).alias("__address")).agg(F.count(F.lit(1)).alias("__rows")).withColumn("__key", ip_key(F.col("__address"))).filter("__address IS NOT NULL AND __key IS NOT NULL")
    bins = F.array(*[F.struct(F.lit(n).alias("__bits"), prefix_of(F.col("__key"), n).alias("__prefix")) for n in lengths]) if lengths else F.array().cast("array<struct<__bits:int,__prefix:string>>")
    found = own.select("__address", "__rows", F.explode(bins).alias("b")).select("__address", "__rows", "b.*")
    if longest:
        found = found.join(table, ["__bits", "__prefix"]).groupBy("__address").agg(F.max_by("__net", "__bits").alias("__net"))
        joined = df.join(found, F.col(address) == F.col("__address"), how)
        return joined.select(*[F.col(f"`{c}`") for c in df.columns], "__net.*")
    # networks of one prefix go together in packs of bounded size; rows and packs meet
    # in cells, of a slice of the prefix's rows and a panel of its packs: a row is sent
    # once for each panel and a pack once for each slice, as the result may be far larger
    # than what it is made from; only that has a row for each pair, and it is not sent on
    parts, keys = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["__bits", "__prefix"]
    cells = found.groupBy(*keys).agg(F.sum("__rows").alias("__all")).join(table.groupBy(*keys).agg(F.count(F.lit(1)).alias("__count")), keys)
    cells = cells.withColumn("__packs", F.ceil(F.col("__count") / PACK)).withColumn("__panels", F.ceil(F.col("__packs") / PANEL))
    wide, rows = F.col("__count") / F.col("__panels"), F.col("__all")
    # slices for all tasks where there are pairs for them and rows for each as many as networks
    spread = F.least(F.lit(parts).cast("long"), F.ceil(rows * wide / PAIRS), F.ceil(rows / wide))
    cells = cells.select(*keys, "__all", "__packs", "__panels", F.greatest(F.ceil(rows / SLICE), spread).alias("__slices"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    packs = table.withColumn("__at", F.monotonically_increasing_id()).join(cells, keys)
    packs = packs.groupBy(*keys, "__panels", "__slices", F.pmod(F.xxhash64("__at"), "__packs").alias("__pack")).agg(F.collect_list("__net").alias("__nets"))
    packs = packs.select(*keys, F.pmod("__pack", "__panels").alias("__panel"), each("__slices").alias("__slice"), "__nets")
    # the filter always holds; with it both uses of the counted addresses read one exchange
    found = found.join(cells, keys).filter("__rows <= __all").select("__address", *keys, "__slices", each("__panels").alias("__panel"))
    dealt = df.withColumn("__at", F.monotonically_increasing_id()).join(found, F.col(address) == F.col("__address"), how)
    # rows that met nothing are dealt out as well
    dealt = dealt.withColumn("__slice", F.pmod(F.xxhash64("__at"), F.coalesce("__slices", F.lit(parts)))).drop("__at", "__address", "__slices")
    keys = [*keys, "__panel", "__slice"]
    dealt, packs = dealt.repartition(parts, *keys), packs.repartition(parts, *keys).hint("merge")
    # rows stream past the packs of their cell: Spark holds what one row unfolds to, at most a panel
    joined = dealt.join(packs, keys, how).filter("__panel IS NULL OR __nets IS NOT NULL")  # no row for a panel that got nothing
    own_columns = [F.col(f"`{c}`") for c in df.columns]
    unfold = F.explode if how == "inner" else F.explode_outer
    return joined.select(*own_columns, unfold("__nets").alias("__net")).select(*own_columns, "__net.*")
