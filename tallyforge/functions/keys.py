"""Surrogate and unknown-member keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Natural keys of the unknown members and the stand-in version time.
UNKNOWN_CUSTOMER = "CUST-UNKNOWN"
UNKNOWN_PRODUCT = "PRD-UNKNOWN"
UNKNOWN_STORE = "ST-UNKNOWN"
UNKNOWN_CAMPAIGN = "CAMP-UNKNOWN"
NO_VERSION_TIME = "1970-01-01"


def surrogate_key(*parts: Column | str) -> Column:
    """md5 of the parts run together; NULL parts are skipped (``concat_ws`` rather than ``concat``)."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("", *[c.cast("string") for c in cols]))


def version_key(natural_key: str, version_time: Column | str) -> Column:
    """Key of one version of a dimension member."""
    time = F.col(version_time) if isinstance(version_time, str) else version_time
    return surrogate_key(
        F.col(natural_key), F.lit("_"), F.coalesce(time.cast("string"), F.lit(NO_VERSION_TIME))
    )


def resolve_key(key: Column | str, unknown: str) -> Column:
    """The dimension key, or the key of the unknown member."""
    return F.coalesce(F.col(key) if isinstance(key, str) else key, F.md5(F.lit(unknown)))


def resolve_version(natural_key: str, valid_from: str, unknown: str) -> Column:
    """``version_key`` of the version that began at ``valid_from``, or the key of the unknown member without one.

    Facts carry the time through their joins, a quarter of the size of the key, which is made from it at the end.
    """
    return resolve_key(F.when(F.col(valid_from).isNotNull(), version_key(natural_key, valid_from)), unknown)
