"""Identifier detection and pseudonyms."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIRECT_NAME = re.compile(r"name|surname|phone|mobile|mail|address|passport|contact", re.I)
QUASI_NAME = re.compile(r"birth|postcode|zip|village|latitude|longitude|gps|ip$", re.I)
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"^[+0-9][0-9 .()/-]{6,}$"


def scan_identifiers(df: DataFrame) -> DataFrame:
    """variable, share_email, share_phone, finding (direct, quasi or null) of the text columns, by content and name.

    Content is judged on all values that are not null, of all columns in one pass.
    """
    spark = df.sparkSession
    names = [name for name, kind in df.dtypes if kind == "string"]
    if not names:
        return spark.createDataFrame([], "variable string, share_email double, share_phone double, finding string")

    def shares(name: str) -> Column:
        v = F.col(f"`{name}`")
        digits = F.length(F.regexp_replace(v, "[^0-9]", ""))
        named = "direct" if DIRECT_NAME.search(name) else "quasi" if QUASI_NAME.search(name) else None
        share = lambda pattern: F.avg(v.rlike(pattern).cast("double"))
        return F.struct(F.lit(name).alias("variable"), share(EMAIL).alias("share_email"), share(PHONE).alias("share_phone"), F.avg(digits).alias("digits"), F.lit(named).cast("string").alias("named"))

    rows = df.agg(F.array(*[shares(name) for name in names]).alias("all")).select(F.inline("all"))
    content = F.when(F.col("share_email") > 0.5, "direct").when((F.col("share_phone") > 0.8) & (F.col("digits") >= 8), "direct")
    return rows.select("variable", "share_email", "share_phone", F.coalesce(content, "named").alias("finding"))


def hmac_sha256(c: Column, key: bytes) -> Column:
    """HMAC-SHA256 in hex. Only the two padded keys stand in the plan, never the key itself."""
    block = (bytes.fromhex(__import__("hashlib").sha256(key).hexdigest()) if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(c, "UTF-8")), 256))), 256)


def pseudonym(c: Column, key: bytes) -> Column:
    """P and ten hex digits; equal values have equal pseudonyms, null stays null."""
    return F.when(c.isNotNull(), F.concat(F.lit("P"), F.substring(hmac_sha256(c.cast("string"), key), 1, 10)))


def apply_actions(df: DataFrame, actions: dict[str, str], key: bytes) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Drop, pseudonymise or keep columns; returns the table and the journal of what was done."""
    journal = []
    for column, action in actions.items():
        if column not in df.columns:
            continue
        if action == "drop":
            df = df.drop(column)
        elif action == "pseudonymise":
            df = df.withColumn(column, pseudonym(F.col(column), key))
        elif action != "keep":
            raise ValueError(f"unknown action {action}")
        journal.append((column, action))
    return df, journal


def network_key(address: Column) -> Column:
    """One key for each IPv4 address and for each /64 of IPv6.

    An IPv6 address in any notation gives its first four groups, without leading zeros and with zero groups at their end
    left out; one that maps an IPv4 address gives that. Anything else is cut to 64 characters.
    """
    low = F.lower(F.trim(address))
    groups = lambda part: F.filter(F.split(part, ":"), lambda g: g != "")
    before = groups(F.substring_index(low, "::", 1))
    after = F.when(F.contains(low, F.lit("::")), groups(F.substring_index(low, "::", -1))).otherwise(F.array().cast("array<string>"))
    zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(before) - F.size(after)))
    first = F.transform(F.slice(F.concat(before, F.when(F.contains(low, F.lit("::")), zeros).otherwise(F.array().cast("array<string>")), after), 1, 4), lambda g: F.regexp_replace(g, "^0+([0-9a-f])", "$1"))
    text = F.regexp_replace(F.array_join(first, ":"), "(^|:)0(:0)*$", "")
    mapped = F.regexp_extract(low, r"^(?:0*:)*:?(?:0+:)*ffff:([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$", 1)
    is_six = low.rlike("^[0-9a-f:]*:[0-9a-f:]*$") & (F.size(before) + F.size(after) <= 8) & (F.contains(low, F.lit("::")) | (F.size(before) == 8))
    return F.when(mapped != "", mapped).when(is_six, F.concat(text, F.lit("::/64"))).otherwise(F.substring(address, 1, 64))


def token_digest(token: Column) -> Column:
    return F.sha2(token, 256)
