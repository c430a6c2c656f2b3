"""Content-derived identifiers as pure columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorebase.functions.text import strip

# fixed values: algorithm labels and separators that enter the digests
CHUNK_ALGORITHM_V1 = "sha256-v1"
CHUNK_ALGORITHM_V2 = "sha256-v2"
SEPARATOR = "\x1f"


def _short(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.left(F.sha2(F.concat_ws(SEPARATOR, *parts), 256), F.lit(32)))


def chunk_id_v1(tenant, version, sequence, source_ids, content) -> Column:
    return _short(
        "chk_",
        F.lit(CHUNK_ALGORITHM_V1),
        strip(tenant),
        strip(version),
        sequence.cast("string"),
        F.array_join(source_ids, ","),
        F.sha2(content, 256),
    )


def chunk_id_v2(tenant, version, strategy, strategy_version, sequence, source_ids, content) -> Column:
    return _short(
        "chk_",
        F.lit(CHUNK_ALGORITHM_V2),
        strip(tenant),
        strip(version),
        strip(strategy),
        strip(strategy_version),
        sequence.cast("string"),
        F.array_join(source_ids, ","),
        F.sha2(strip(content), 256),
    )


def artifact_id(capability, tenant, version, build, source_ids, text) -> Column:
    """``adv_`` id over capability, scope, build, every source id and the stripped text."""
    return _short(
        "adv_",
        capability,
        strip(tenant),
        strip(version),
        strip(build),
        F.array_join(source_ids, SEPARATOR),
        strip(text),
    )


def job_id(tenant, key) -> Column:
    return _short("job_", tenant, key)


def digest(col: Column) -> Column:
    return F.sha2(col, 256)


def filter_digest(payload: Column) -> Column:
    """First 16 hex digits of the JSON of a filter, ``none`` when there is no filter."""
    return F.coalesce(F.left(F.sha2(F.to_json(payload), 256), F.lit(16)), F.lit("none"))
