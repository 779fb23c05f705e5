"""A Spark data source over slide folders: spark.read.format("slides").load(folder) gives a row per directory entry.

Filters on tag_id and dir are pushed into the decoder, which then reads no value of any other tag, and files are
read by seeking, whatever their size: what isn't metadata never leaves the store.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from sablelens.functions import fields as P
from sablelens.sources.files import TIFF_SUFFIXES, open_file, store_of
from sablelens.sources.tiff import NAMES, TAGS, tag_rows

#: Files that one task reads, at most.
FILES = 32
SUFFIXES = {e for exts in P.EXTENSIONS.values() for e in exts} & set(TIFF_SUFFIXES)


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class SlideReader(DataSourceReader):
    def __init__(self, root: str):
        self.root, self.tags, self.dirs = root, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            values = set(f.value) if isinstance(f, In) else {f.value} if isinstance(f, EqualTo) else None
            if values is not None and f.attribute == ("tag_id",):
                self.tags = values if self.tags is None else self.tags & values
            elif values is not None and f.attribute == ("dir",):
                self.dirs = values if self.dirs is None else self.dirs & values
            else:
                yield f

    def partitions(self) -> list[Files]:
        store, place = store_of(self.root)
        found = sorted(i.path for i in store.get_file_info(pafs.FileSelector(place, recursive=True)) if i.type == pafs.FileType.File and i.extension.lower() in SUFFIXES)
        scheme = self.root.split("://")[0] + "://" if "://" in self.root else ""
        return [Files([scheme + p for p in found[k : k + FILES]]) for k in range(0, len(found), FILES)]

    def read(self, partition: Files) -> Iterator[tuple]:
        tag_at, dir_at = NAMES.index("tag_id"), NAMES.index("dir")
        for path in partition.paths:
            try:
                with open_file(path) as f:
                    rows = tag_rows(path, f, self.tags)
            except OSError as why:
                rows = [(path, *[None] * (len(NAMES) - 2), str(why))]
            for row in rows:
                # The row of a file that can't be read passes no filter.
                if (self.tags is None or row[tag_at] in self.tags) and (self.dirs is None or row[dir_at] in self.dirs):
                    yield row


class SlideSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "slides"

    def schema(self) -> str:
        return TAGS

    def reader(self, schema) -> SlideReader:
        return SlideReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SlideSource)
