"""Validators of semantic types and content fingerprints.

A validator turns a string column into its normalised value, null where it is
not valid; :func:`validate` adds the fingerprint and the error.  All but SHA-3,
e-mail and expression checks are plain columns.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import net
from .casts import NUMBER

_HEX_LENGTHS = {"md5": (32, 16), "sha1": (40,), "sha224": (56,), "sha256": (64,), "sha384": (96,), "sha512": (128,), "sha3_224": (56,), "sha3_256": (64,), "sha3_384": (96,), "sha3_512": (128,), "sha512_224": (56,), "sha512_256": (64,)}
#: The accepted forms of names, media types and telephone numbers.
#: Names and media types are read in lower case.
FQDN = r"^[a-z0-9]+(?:-{1,2}[a-z0-9]+|\.[a-z0-9]+)*\.[a-z]{2,20}\z"
MIME = r"^[a-z]+/(?:[a-z0-9]+[a-z0-9+,\-.][a-z0-9]+)+\z"
PHONE = r"^\+[1-9][0-9]{0,2}(?:\s?\([1-9][0-9]{0,3}\))?(?:\s?-?[0-9]{1,4}){1,3}\z"
#: A UUID: plain, in braces, after urn:uuid:, or its 32 digits.
UUID = r"^(?:urn:uuid:)?([0-9a-f]{8})-([0-9a-f]{4})-([0-9a-f]{4})-([0-9a-f]{4})-([0-9a-f]{12})\z|^\{([0-9a-f]{8})-([0-9a-f]{4})-([0-9a-f]{4})-([0-9a-f]{4})-([0-9a-f]{12})\}\z|^[0-9a-f]{32}\z"
#: A request target: an absolute path, or a scheme with what follows it.
URL = r"^(?:/[^\s\x00-\x1F\x7F]*|[a-zA-Z][a-zA-Z0-9+.-]*:[^\s\x00-\x1F\x7F]*)\z"

#: Networks whose addresses are not public.
PRIVATE = ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "fc00::/7"]
SPECIAL = ["127.0.0.0/8", "169.254.0.0/16", "224.0.0.0/4", "0.0.0.0/32", "::1/128", "::/128", "fe80::/10", "ff00::/8"]


def _if(ok: Column, value: Column) -> Column:
    return F.when(ok, value)


def text(x: Column, lower: bool = False) -> Column:
    """Up to 64 KiB; characters that are no letters, digits, marks of speech,
    blanks or symbols become blanks; not blank."""
    clean = F.regexp_replace(x, r"[^\p{L}\p{N}\p{P}\p{S}\s]", " ")
    return _if((F.octet_length(x) <= 65_536) & (F.trim(clean) != ""), F.lower(clean) if lower else clean)


def ip(x: Column) -> Column:
    good = net.ip_key(x).isNotNull() & ~net.in_networks(x, PRIVATE + SPECIAL)
    return _if(good, F.lower(x))


@F.pandas_udf(StringType())
def cidr(x: pd.Series) -> pd.Series:
    import ipaddress

    closed = [ipaddress.ip_network(n) for n in PRIVATE + SPECIAL]

    def one(v):
        try:
            host = ipaddress.ip_interface(v)
        except (ValueError, TypeError):
            return None
        if "/" not in v or any(host.ip in n for n in closed if n.version == host.version):
            return None
        return str(host.network)

    return x.map(one)


def date(x: Column) -> Column:
    return _if(x.rlike(r"^\d{4}-\d{2}-\d{2}$") & x.try_cast("date").isNotNull(), x)


def datetime(x: Column) -> Column:
    """RFC 3339; zeros at the end of a fraction go, the offset stays."""
    ok = x.rlike(r"^\d{4}-\d{2}-\d{2}T([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?(Z|[+-]\d{2}:\d{2})$") & F.substring(x, 1, 10).try_cast("date").isNotNull()
    return _if(ok, F.regexp_replace(F.regexp_replace(x, r"(\.\d*?)0+(?=Z|[+-]\d{2}:)", "$1"), r"\.(?=Z|[+-])", ""))


def integer(x: Column) -> Column:
    return _if(x.rlike(r"^[+-]?[0-9]+$"), x.try_cast("long").cast("string"))


def float_(x: Column) -> Column:
    return _if(x.rlike(NUMBER), x.try_cast("double").cast("string"))


def boolean(x: Column) -> Column:
    return F.when(x.isin("1", "t", "T", "TRUE", "true", "True"), F.lit("true")).when(x.isin("0", "f", "F", "FALSE", "false", "False"), F.lit("false"))


@F.pandas_udf(StringType())
def email(x: pd.Series) -> pd.Series:
    from email.utils import parseaddr

    def one(v):
        address = parseaddr(v)[1].lower() if v else ""
        return address if re.fullmatch(r"[^@\s]+@[^@\s]+", address) else None

    return x.map(one)


def fqdn(x: Column) -> Column:
    return _if(F.lower(x).rlike(FQDN), F.lower(x))


def url(x: Column) -> Column:
    """An absolute path, or an address with its scheme and host in lower case."""
    head = F.regexp_extract(x, r"^[a-zA-Z][a-zA-Z0-9+.-]*:(?://[^/?#]*)?", 0)
    return _if(x.rlike(URL), F.concat(F.lower(head), F.substring(x, F.length(head) + 1, F.length(x))))


def mac(x: Column) -> Column:
    return _if(F.upper(x).rlike(r"^([0-9A-F]{2}-){5}[0-9A-F]{2}$"), F.upper(x))


def mime(x: Column) -> Column:
    return _if(F.lower(x).rlike(MIME), F.lower(x))


def path(x: Column) -> Column:
    return _if(~x.contains("://") & (x != ""), F.lower(x))


def phone(x: Column) -> Column:
    return _if(x.rlike(PHONE), x)


def port(x: Column) -> Column:
    n = F.regexp_extract(x, r"^(\d+)/", 1).try_cast("int")
    return _if(F.lower(x).rlike(r"^\d{1,5}/(tcp|udp)$") & n.between(1, 65_535), F.lower(x))


def title(x: Column) -> Column:
    return _if(F.trim(x) != "", F.initcap(F.lower(x)))


def base64(x: Column) -> Column:
    return _if(x.rlike(r"^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$") & (x != ""), x)


def hexadecimal(x: Column) -> Column:
    return _if(F.lower(x).rlike("^([0-9a-f]{2})+$"), F.lower(x))


def digest(kind: str):
    lengths = "|".join(f"[0-9a-f]{{{n}}}" for n in _HEX_LENGTHS[kind])
    return lambda x: _if(F.lower(x).rlike(f"^({lengths})$"), F.lower(x))


def uuid(x: Column) -> Column:
    """In the plain form."""
    figures = F.regexp_replace(F.lower(x), "^urn:uuid:|[{}-]", "")
    plain = F.concat_ws("-", *[F.substring(figures, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return _if(F.lower(x).rlike(UUID), plain)


def identifier(x: Column) -> Column:
    return F.coalesce(digest("md5")(x), digest("sha3_256")(x), uuid(x))


def matches_whole(x: Column, pattern: str) -> Column:
    """The value if the pattern, found in it once from the left, is all of it."""
    from .record import engine_pattern

    return _if((F.regexp_extract(x, engine_pattern(pattern), 0) == x) & x.rlike(engine_pattern(pattern)), x)


def adversary(x: Column) -> Column:
    """A name: none of the machine-readable kinds."""
    other = F.coalesce(url(x), uuid(x), fqdn(x), phone(x), ip(x), F.when(x.rlike(r"^[^@\s]+@[^@\s]+$"), x))
    return _if(other.isNull(), text(x))


def expression(x: Column) -> Column:
    """A pattern that the engine accepts that would run it; named groups may be
    written either way."""
    plain = F.regexp_replace(x, r"(?<!\\)((?:\\\\)*)\(\?P?<[A-Za-z]\w*>", "$1(")
    return _if(F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), plain).isNotNull(), x)


@F.pandas_udf(StringType())
def fingerprint(x: pd.Series) -> pd.Series:
    """SHA3-256 of the value, in hexadecimal."""
    return x.map(lambda v: None if v is None else hashlib.sha3_256(v.encode()).hexdigest())


VALIDATORS = {
    "str": text,
    "istr": lambda x: text(x, lower=True),
    "ip": ip,
    "cidr": cidr,
    "date": date,
    "datetime": datetime,
    "integer": integer,
    "float": float_,
    "boolean": boolean,
    "email": email,
    "fqdn": fqdn,
    "url": url,
    "mac": mac,
    "mime": mime,
    "path": path,
    "phone": phone,
    "port": port,
    "city": title,
    "country": title,
    "base64": base64,
    "hexadecimal": hexadecimal,
    **{kind: digest(kind) for kind in _HEX_LENGTHS},
    "uuid": uuid,
    "identifier": identifier,
    "adversary": adversary,
    "regex": expression,
}


def validate(x: Column, kind: str) -> Column:
    """struct(value, hash, error) for a kind of ``VALIDATORS``."""
    value = VALIDATORS[kind](x)
    return F.struct(value.alias("value"), fingerprint(value).alias("hash"), F.when(value.isNull(), F.concat(F.lit(f"not a valid {kind}: "), F.coalesce(x, F.lit("null")))).alias("error"))
