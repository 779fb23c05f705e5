"""MRXS: findings over INI rows (keys..., section, key, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sablelens.functions import tables as T
from sablelens.functions.fields import all_x, strip


def ini_done(value: Column) -> Column:
    """Empty, all X, or a date that means removed."""
    bare = strip(value)
    return (bare == "") | all_x(bare) | bare.startswith("19000101")


def general_findings(ini: DataFrame, keys: list[str]) -> DataFrame:
    """Identifying fields of the section GENERAL, in any case."""
    left = (F.col("section") == "GENERAL") & F.upper("key").isin(*T.MRXS_GENERAL) & ~ini_done(F.col("value"))
    return ini.where(left).select(*keys, "section", "key", "value")


def section_findings(ini: DataFrame, keys: list[str], general_too: bool = False) -> DataFrame:
    """Identifying fields of other sections; general_too looks for them in GENERAL as well."""
    where = F.lit(True) if general_too else F.col("section") != "GENERAL"
    return ini.where(where & F.upper("key").isin(*T.MRXS_OTHER) & ~ini_done(F.col("value"))).select(*keys, "section", "key", "value")


def associated_images(ini: DataFrame, keys: list[str]) -> DataFrame:
    """keys, image, layer, section, dat_key, start, size: label, macro and thumbnail images that non-hierarchical layers name.

    A chain of equi-joins: layer name -> its section (or the one built from its place) -> file, offset and size.
    """
    tree = ini.where("section = 'HIERARCHICAL'").select(*keys, "key", "value")
    total = tree.where("key = 'NONHIER_COUNT'").select(*keys, F.expr("try_cast(value AS INT)").alias("_total"))
    counts = tree.select(*keys, F.expr("try_cast(regexp_extract(key, '^NONHIER_([0-9]+)_COUNT$', 1) AS INT)").alias("_layer"), F.expr("try_cast(value AS INT)").alias("_count")).where("_layer IS NOT NULL")
    at = lambda group: F.expr(f"try_cast(regexp_extract(key, '^NONHIER_([0-9]+)_VAL_([0-9]+)$', {group}) AS INT)")
    layers = tree.select(*keys, at(1).alias("_layer"), at(2).alias("_place"), strip(F.col("value")).alias("layer")).where(F.col("_layer").isNotNull() & F.col("layer").isin(*T.MRXS_LAYERS))
    layers = layers.join(total, keys).where("_layer < _total").join(counts, [*keys, "_layer"]).where("_place < _count")
    named = tree.select(*keys, F.regexp_extract("key", "^(NONHIER_[0-9]+_VAL_[0-9]+)_SECTION$", 1).alias("_val"), F.col("value").alias("_named")).where("_val <> ''")
    layers = layers.withColumn("_val", F.concat(F.lit("NONHIER_"), "_layer", F.lit("_VAL_"), "_place")).join(named, [*keys, "_val"], "left")
    section = F.coalesce("_named", F.concat(F.lit("NONHIER_"), "_layer", F.lit("_LEVEL_"), "_place"))
    kinds = F.create_map(*(F.lit(x) for pair in T.MRXS_LAYERS.items() for x in pair))
    layers = layers.withColumn("section", section).withColumn("image", kinds[F.col("layer")])

    def first(names: tuple[str, ...]) -> Column:
        """The value of the first of these keys that the section has."""
        return F.min_by("value", F.when(F.col("key").isin(*names), F.array_position(F.array(*map(F.lit, names)), F.col("key"))))

    wanted = ini.where(F.col("key").isin("FILE", "IMAGEFILE", *T.MRXS_OFFSET_KEYS, *T.MRXS_SIZE_KEYS))
    facts = wanted.groupBy(*keys, "section").agg(first(("FILE", "IMAGEFILE")).alias("dat_key"), first(T.MRXS_OFFSET_KEYS).alias("_start"), first(T.MRXS_SIZE_KEYS).alias("_size"))
    number = lambda c: F.coalesce(F.expr(f"try_cast({c} AS BIGINT)"), F.lit(0).cast("long")).alias(c[1:])
    return layers.join(facts, [*keys, "section"], "left").select(*keys, "image", "layer", "section", "dat_key", number("_start"), number("_size"))


def resolved_files(images: DataFrame, ini: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """images with dat_file: the named file if it exists (files: keys, name, length), else the one that [DATAFILE] gives for it.

    Size, where none is given, is the rest of the file. An image of neither stays without a file and is not
    patched, rather than being taken for the first data file.
    """
    direct = files.select(*keys, F.col("name").alias("dat_key"), F.col("name").alias("_direct"), F.col("length").alias("_n1"))
    by_key = ini.where("section = 'DATAFILE'").select(*keys, F.col("key").alias("dat_key"), F.col("value").alias("name"))
    by_key = by_key.join(files.select(*keys, "name", F.col("length").alias("_n2")), [*keys, "name"]).select(*keys, "dat_key", F.col("name").alias("_listed"), "_n2")
    out = images.join(direct, [*keys, "dat_key"], "left").join(by_key, [*keys, "dat_key"], "left")
    length = F.coalesce("_n1", "_n2")
    size = F.when(F.col("size") > 0, F.col("size")).otherwise(F.greatest(length - F.col("start"), F.lit(0)))
    return out.withColumn("dat_file", F.coalesce("_direct", "_listed")).withColumn("size", size).drop("_direct", "_listed", "_n1", "_n2")


def redacted_ini(ini: DataFrame) -> DataFrame:
    """Identifying values replaced: dates and times by a sentinel, others by as many X."""
    touched = ((F.col("section") == "GENERAL") & F.upper("key").isin(*T.MRXS_GENERAL) | (F.col("section") != "GENERAL") & F.upper("key").isin(*T.MRXS_OTHER)) & ~ini_done(F.col("value"))
    timed = F.upper("key").contains("DATE") | F.upper("key").contains("TIME")
    new = F.when(timed, "19000101000000").otherwise(F.repeat(F.lit("X"), F.length("value")))
    return ini.withColumn("value", F.when(touched, new).otherwise(F.col("value")))
