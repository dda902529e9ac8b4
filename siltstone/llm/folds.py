"""Folds by document id, and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEPS = 1_000_000


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo `n`; a null id has the fold of the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def sampled(key: Column, rate: Column) -> Column:
    """True for a share `rate` of the keys, the same ones in every run and on every cluster."""
    return F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(_STEPS)) < rate * _STEPS
