"""Is a URL's host local or private?"""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Name endings of private networks.
PRIVATE_SUFFIXES = (".local", ".internal", ".lan", ".localdomain")


def url_host(url: Column) -> Column:
    """Lower-case host, cut by its delimiters: names with `_` count; a missing scheme is tolerated; empty if there is none."""
    full = F.when(F.contains(url, F.lit("://")), F.trim(url)).otherwise(F.concat(F.lit("http://"), F.trim(url)))
    return F.lower(F.coalesce(F.regexp_extract(full, r"^[^:/?#]+://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^:/?#\[\]\s]*)", 1), F.lit("")))


@F.pandas_udf(T.BooleanType())
def _private_address(hosts: pd.Series) -> pd.Series:
    def one(host):
        try:
            ip = ipaddress.ip_address(host.strip("[]"))
        except ValueError:
            return False
        return ip.is_loopback or ip.is_private or ip.is_link_local or ip.is_unspecified
    return hosts.map(lambda h: bool(h) and one(h))


def is_private_host(url: Column) -> Column:
    """Names are judged natively; only hosts shaped like an address reach Python's address tables."""
    host = url_host(url)
    named = (host == "localhost") | host.rlike("(?:" + "|".join(s.replace(".", r"\.") for s in PRIVATE_SUFFIXES) + ")$")
    address = host.rlike(r"^[0-9.]+$|:")
    return named | (address & _private_address(F.when(address, host).otherwise(F.lit(""))))
