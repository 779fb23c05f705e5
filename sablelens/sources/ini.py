"""Slidedat.ini files of MRXS slides as rows."""

from __future__ import annotations

import configparser
import io

from pyspark.sql import DataFrame

from sablelens.sources.files import open_file

INI = "path string, ini string, section string, key string, value string, error string"


def parse_ini(text: str) -> list[tuple[str, str, str]]:
    """(section, key, value); keys keep their case, percent signs mean nothing, a byte-order mark is skipped."""
    reader = configparser.RawConfigParser(strict=False)
    reader.optionxform = str
    reader.read_file(io.StringIO(text.removeprefix("﻿")))
    return [(s, k, v) for s in reader.sections() for k, v in reader.items(s)]


def _rows(path: str) -> list[tuple]:
    ini = path.rsplit(".", 1)[0] + "/Slidedat.ini"
    try:
        with open_file(ini) as f:
            return [(path, ini, s, k, v, None) for s, k, v in parse_ini(f.read().decode("utf-8", "replace"))]
    except (OSError, configparser.Error) as why:
        return [(path, ini, None, None, None, str(why))]


def read_ini(files: DataFrame) -> DataFrame:
    """Rows of the Slidedat.ini in the folder named as the slide; one with an error where there is none."""
    import pandas as pd

    def run(batches):
        for batch in batches:
            rows = [r for path in batch["path"] for r in _rows(path)]
            yield pd.DataFrame(rows, columns=["path", "ini", "section", "key", "value", "error"])

    return files.select("path").mapInPandas(run, INI)
