"""Addresses: private and reserved ranges, allowed targets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import host


def private_ipv4(ip: Column) -> Column:
    """Whether an IPv4 address is private, local or reserved; null for what is no address."""
    parts = F.transform(F.split(ip, r"\."), lambda x: x.try_cast("int"))
    a, b = F.get(parts, 0), F.get(parts, 1)
    sound = (F.size(parts) == 4) & F.forall(parts, lambda x: F.coalesce(x.between(0, 255), F.lit(False)))
    private = a.isin(0, 10, 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | (a >= 224)
    return F.when(sound, private)


def allowed_url(url: Column, suffixes: tuple[str, ...]) -> Column:
    """Whether a URL is http(s) and its host is one of ``suffixes`` or below one."""
    name = host(url)
    under = F.lit(False)
    for s in suffixes:
        under = under | (name == s) | F.endswith(name, F.lit(f".{s}"))
    return F.coalesce(F.lower(url).rlike("^https?://") & under, F.lit(False))
