"""DICOM: findings over element rows (keys..., depth, tag 'gggg,eeee', vr, private, value)."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sablelens.functions import tables as T
from sablelens.functions.fields import dicom_done, dicom_replacement

#: Deepest nested dataset that is looked into, counting the elements of the top level as 0.
DEEPEST = 6
#: Fixed value: root of generated identifiers, the arc for UUID-derived ones.
UID_ROOT = "2.25."
#: The elements that say that a file was anonymised.
MARKS = (("0012,0062", "CS", "YES"), ("0012,0063", "LO", "Identifiers removed or replaced"))


def is_blank() -> Column:
    """Whether an element is one of the top level to blank, and isn't blank already."""
    return (F.col("depth") == 0) & F.col("tag").isin(*(t for t, _, _ in T.dicom_blank())) & ~dicom_done(F.col("vr"), F.col("value"))


def is_deleted() -> Column:
    return (F.col("depth") == 0) & F.col("tag").isin(*(t for t, _ in T.dicom_delete()))


def is_nested() -> Column:
    return F.col("depth").between(1, DEEPEST) & F.col("tag").isin(*T.DICOM_NESTED) & ~dicom_done(F.col("vr"), F.col("value"))


def blank_findings(elements: DataFrame) -> DataFrame:
    return elements.where(is_blank())


def delete_findings(elements: DataFrame) -> DataFrame:
    return elements.where(is_deleted())


def nested_findings(elements: DataFrame) -> DataFrame:
    return elements.where(is_nested())


def private_counts(elements: DataFrame, keys: list[str]) -> DataFrame:
    return elements.where("private AND depth = 0").groupBy(*keys).agg(F.count("*").alias("private_tags"))


def nested_private_counts(elements: DataFrame, keys: list[str]) -> DataFrame:
    return elements.where("private AND depth > 0").groupBy(*keys).agg(F.count("*").alias("private_tags"))


@F.pandas_udf(StringType())
def remapped_uid(uid: pd.Series, path: pd.Series) -> pd.Series:
    """The same identifier in the same file always becomes the same other one: 128 bits of a hash, which no JVM number type holds."""
    return pd.Series([None if u is None else (UID_ROOT + str(int(hashlib.sha256(f"{u}:{p}".encode()).hexdigest()[:32], 16)))[:64] for u, p in zip(uid, path, strict=True)])


def anonymised(elements: DataFrame, path: str) -> DataFrame:
    """Element rows after anonymisation: blanked, deleted, identifiers replaced, private ones gone, and the two marks that say so."""
    blank = F.col("tag").isin(*(t for t, _, _ in T.dicom_blank())) & (F.col("depth") == 0) | F.col("tag").isin(*T.DICOM_NESTED) & F.col("depth").between(1, DEEPEST)
    gone = F.col("private") | (F.col("depth") == 0) & F.col("tag").isin(*(t for t, _ in T.dicom_delete()))
    kept = elements.where(~gone)
    uid = F.col("tag").isin(*T.DICOM_UIDS) & (F.col("depth") == 0) & ~F.col("value").startswith(UID_ROOT)
    value = F.when(blank & ~dicom_done(F.col("vr"), F.col("value")), dicom_replacement(F.col("vr"))).when(uid, remapped_uid("value", path)).otherwise(F.col("value"))
    marked = kept.withColumn("value", value)
    files = elements.select(path).distinct()
    added = None
    for tag, vr, text in MARKS:
        row = files.select(path, F.lit(0).alias("depth"), F.lit(tag).alias("tag"), F.lit(vr).alias("vr"), F.lit(False).alias("private"), F.lit(text).alias("value"))
        added = row if added is None else added.unionByName(row)
    return marked.where(~F.col("tag").isin(*(t for t, _, _ in MARKS))).unionByName(added, allowMissingColumns=True)
