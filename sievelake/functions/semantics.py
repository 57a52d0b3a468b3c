"""Semantic types of values and attributes, each with the kind that validates it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .casts import number
from .entities import validate

#: Each semantic type and the kind of validator that checks it.
KINDS: dict[str, str] = {
    "aba-rtn": "integer",
    "accuracy-radius": "float",
    "adversary": "adversary",
    "airport-name": "istr",
    "asn": "integer",
    "aso": "istr",
    "authentihash": "hexadecimal",
    "bank-account-nr": "integer",
    "base64": "base64",
    "bic": "istr",
    "bin": "integer",
    "breach": "uuid",
    "breach-count": "integer",
    "breach-date": "date",
    "breach-description": "str",
    "btc": "str",
    "category": "istr",
    "cc-number": "integer",
    "cdhash": "hexadecimal",
    "certificate-fingerprint": "hexadecimal",
    "chrome-extension-id": "str",
    "cidr": "cidr",
    "city": "city",
    "command": "str",
    "cookie": "str",
    "country": "country",
    "cpe": "istr",
    "cve": "istr",
    "dash": "str",
    "date": "date",
    "date-of-issue": "date",
    "datetime": "datetime",
    "dkim": "str",
    "dkim-signature": "str",
    "domain": "fqdn",
    "email": "str",
    "email-address": "email",
    "email-body": "istr",
    "email-display-name": "istr",
    "email-header": "str",
    "email-mime-boundary": "str",
    "email-subject": "istr",
    "email-thread-index": "base64",
    "email-x-mailer": "istr",
    "eppn": "email",
    "expiration-date": "date",
    "facebook-profile": "url",
    "ffn": "str",
    "file": "identifier",
    "file-data": "url",
    "filename": "istr",
    "filename-pattern": "regex",
    "flight": "str",
    "github-organization": "url",
    "github-repository": "url",
    "github-user": "url",
    "group": "adversary",
    "hex": "hexadecimal",
    "hostname": "fqdn",
    "iban": "istr",
    "id-number": "str",
    "ip": "ip",
    "issuer": "istr",
    "issuing-country": "country",
    "ja3-fingerprint": "md5",
    "jabber-id": "email",
    "jarm-fingerprint": "hexadecimal",
    "last-analysis": "datetime",
    "latitude": "float",
    "link": "url",
    "longitude": "float",
    "mac-address": "mac",
    "malware": "istr",
    "malware-family": "istr",
    "malware-sample": "url",
    "malware-type": "istr",
    "md5": "md5",
    "mime-type": "mime",
    "mobile-app-id": "str",
    "os": "istr",
    "passport": "str",
    "password": "str",
    "path": "path",
    "pattern-in-file": "regex",
    "pattern-in-memory": "regex",
    "pattern-in-traffic": "regex",
    "payload": "sha3_256",
    "pgp-private-key": "str",
    "pgp-public-key": "str",
    "phone": "phone",
    "pnr": "str",
    "port": "port",
    "postal-address": "istr",
    "process": "istr",
    "process-state": "istr",
    "profile-photo": "url",
    "prtn": "istr",
    "redress-number": "str",
    "regkey": "istr",
    "sha1": "sha1",
    "sha224": "sha224",
    "sha256": "sha256",
    "sha3-224": "sha3_224",
    "sha3-256": "sha3_256",
    "sha3-384": "sha3_384",
    "sha3-512": "sha3_512",
    "sha384": "sha384",
    "sha512": "sha512",
    "sha512-224": "sha512_224",
    "sha512-256": "sha512_256",
    "size-in-bytes": "float",
    "ssh-banner": "str",
    "ssh-fingerprint": "str",
    "ssr": "str",
    "text": "istr",
    "threat": "istr",
    "tiktok-profile": "url",
    "twitter-profile": "url",
    "url": "url",
    "username": "istr",
    "value": "str",
    "visa": "str",
    "whois-registrant": "istr",
    "whois-registrar": "istr",
    "windows-scheduled-task": "istr",
    "windows-service-displayname": "istr",
    "windows-service-name": "istr",
    "xmr": "str",
    "zip-code": "str",
}


def validate_semantic(x: Column, name: str) -> Column:
    """struct(value, hash, error) of a string column for a semantic type."""
    if name not in KINDS:
        raise ValueError(f"no such semantic type: {name}")
    return validate(x, KINDS[name])


def attributes(columns: dict[str, Column]) -> Column:
    """A map of the attributes that have a value, as strings."""
    unknown = sorted(set(columns) - set(KINDS))
    if unknown:
        raise ValueError(f"no such semantic types: {unknown}")
    pairs = F.array_compact(F.array(*[F.when(c.isNotNull(), F.struct(F.lit(n), c.cast("string"))) for n, c in columns.items()]))
    return F.map_from_entries(pairs)


#: Spark types of kinds that are not strings.
_STORED = {"integer": "bigint", "port": "bigint", "float": "double"}


def stored_type(name: str) -> str:
    """The Spark type of an attribute."""
    if name not in KINDS:
        raise ValueError(f"no such semantic type: {name}")
    return _STORED.get(KINDS[name], "string")


def coerced(value: Column, kind: str, to: str) -> tuple[Column, Column]:
    """(the value in a type, whether it could be): strings print anything; whole
    numbers take numbers, cut off, and plain decimal digits; fractions take numbers
    and strings that read as one.  Null becomes null; truth values are no numbers."""
    if to == "string":
        return value.cast("string"), F.lit(True)
    numeric = kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")
    if numeric:
        return value.try_cast(to), value.isNull() | value.try_cast(to).isNotNull()
    if kind == "string":
        read = F.when(value.rlike(r"^[+-]?[0-9]+$"), value.try_cast("bigint")) if to == "bigint" else number(value)
        return read, value.isNull() | read.isNotNull()
    return F.lit(None).cast(to), value.isNull()


def set_attribute(df: DataFrame, name: str, value: Column, found: str | None = None) -> DataFrame:
    """``df`` with the attribute ``name`` set to a value coerced to its type; a value
    that cannot be leaves the old one.  ``found`` names a column for whether it was set."""
    to = stored_type(name)
    new, good = coerced(value, df.select(value.alias("v")).dtypes[0][1], to)
    old = F.col(f"`{name}`") if name in df.columns else F.lit(None).cast(to)
    out = {name: F.when(good, new).otherwise(old)} | ({found: good} if found else {})
    return df.withColumns(out)
