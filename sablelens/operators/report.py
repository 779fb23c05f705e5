"""Summaries, certificates and reports over result rows."""

from __future__ import annotations

import json
import os
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sablelens.sources import files as S

#: Fixed value: the certificate's form.
VERSION = "1.0"


def batch_stats(results: DataFrame) -> DataFrame:
    """total, errored, anonymized (something cleared), already_clean, in one pass."""
    fine = F.col("error").isNull()
    return results.agg(F.count("*").alias("total"), F.count_if(~fine).alias("errored"), F.count_if(fine & (F.col("cleared") > 0)).alias("anonymized"), F.count_if(fine & (F.col("cleared") == 0)).alias("already_clean"))


def scan_summary(results: DataFrame) -> DataFrame:
    """total, clean, errors, findings, with_findings; a file that could not be read is never clean."""
    fine = F.col("error").isNull()
    return results.agg(
        F.count("*").alias("total"),
        F.count_if(fine & (F.col("n_findings") == 0)).alias("clean"),
        F.count_if(~fine).alias("errors"),
        F.coalesce(F.sum("n_findings"), F.lit(0)).cast("long").alias("findings"),
        F.count_if(fine & (F.col("n_findings") > 0)).alias("with_findings"),
    )


def measures(results: DataFrame, timestamps_reset: bool = False) -> DataFrame:
    """measure, status: what was done to the batch, from one pass over it."""
    s = results.agg(F.coalesce(F.sum("cleared"), F.lit(0)).alias("n"), F.count("*").alias("t"), F.count_if("verified").alias("v"), F.count_if("integrity").alias("ok"), F.count_if(~F.col("integrity")).alias("bad"))
    applied = F.when(F.col("n") > 0, "applied").otherwise("not_needed")
    rows = [
        F.struct(F.lit("Metadata tags cleared").alias("measure"), applied.alias("status")),
        F.struct(F.lit("Label/macro images blanked").alias("measure"), applied.alias("status")),
        F.struct(F.lit("Post-anonymization verification").alias("measure"), F.when((F.col("v") == F.col("t")) & (F.col("v") > 0), "passed").otherwise("skipped").alias("status")),
        F.struct(F.lit("Image data integrity (SHA-256)").alias("measure"), F.when(F.col("ok") + F.col("bad") == 0, None).when(F.col("bad") == 0, "passed").otherwise("failed").alias("status")),
    ]
    if timestamps_reset:
        rows.append(F.struct(F.lit("Filesystem timestamps reset").alias("measure"), F.lit("applied").alias("status")))
    return s.select(F.explode(F.array(*rows)).alias("m")).select("m.*").where("status IS NOT NULL")


def integrity(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, verified: whether every image that is still there has its old hash (both sides: path, ifd_offset, sha256)."""
    new = after.select("path", "ifd_offset", F.col("sha256").alias("_after"))
    return before.join(new, ["path", "ifd_offset"]).groupBy("path").agg(F.bool_and(F.col("sha256") == F.col("_after")).alias("verified"))


def space_needed(files: DataFrame, free: int) -> DataFrame:
    """files, needed, space: error if the files don't fit into `free` bytes, warning if with a tenth more they wouldn't."""
    total = F.coalesce(F.sum("length"), F.lit(0)).cast("long")
    return files.agg(F.count("*").alias("files"), total.alias("needed")).withColumn("space", F.when(F.col("needed") > free, "error").when(F.col("needed") * 1.1 > free, "warning").otherwise("ok"))


def preflight(files: DataFrame, output: str | None = None, free: int | None = None) -> DataFrame:
    """level (error or warning), message: what keeps a batch from being written. files: path, name, length.

    Files that can't be opened are looked for by the executors; a batch without files is an error, and so is an output that
    isn't a folder that can be written to, or too little space for copies.
    """
    spark = files.sparkSession
    found = [("error", "No files to process.")] if files.isEmpty() else []
    if output is not None and "://" not in output:
        if os.path.exists(output):
            if not os.path.isdir(output):
                found.append(("error", f"Output path exists but is not a directory: {output}"))
            elif not os.access(output, os.W_OK):
                found.append(("error", f"Output directory is not writable: {output}"))
        elif os.access(os.path.dirname(os.path.abspath(output)), os.W_OK):
            found.append(("warning", f"Output directory will be created: {output}"))
        else:
            found.append(("error", f"Cannot create output directory (parent not writable): {output}"))
    own = spark.createDataFrame(found, "level string, message string")
    closed = S.with_heads(files.select("path", "name"), 1).where("head IS NULL").select(F.lit("error").alias("level"), F.concat(F.lit("Cannot read "), "name").alias("message"))
    if free is None:
        return own.unionByName(closed)
    space = space_needed(files, free).where("space <> 'ok'")
    words = F.when(F.col("space") == "error", "Insufficient disk space: need ").otherwise("Low disk space: need ")
    return own.unionByName(closed).unionByName(space.select(F.col("space").alias("level"), F.concat(words, "needed", F.lit(f" bytes, have {free}")).alias("message")))


def log_line(level: Column | str, message: Column | str) -> Column:
    """[time] [LEVEL] message, the message at the same place for every level."""
    level = F.col(level) if isinstance(level, str) else level
    return F.concat(F.lit("["), F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"), F.lit("] "), F.rpad(F.concat(F.lit("["), F.upper(level), F.lit("]")), 7, " "), F.lit(" "), F.col(message) if isinstance(message, str) else message)


def result_log(results: DataFrame) -> DataFrame:
    """line: a log line for each result row, errors as such and files that aren't verified as warnings."""
    level = F.when(F.col("error").isNotNull(), "ERROR").when(~F.col("verified"), "WARN").otherwise("INFO")
    message = F.concat("path", F.when(F.col("error").isNotNull(), F.concat(F.lit(": "), "error")).otherwise(F.concat(F.lit(": "), F.col("cleared").cast("string"), F.lit(" cleared"))))
    return results.select("path", log_line(level, message).alias("line")).orderBy("path").select("line")


def sanitized(text: Column) -> Column:
    """Anything but printable ASCII as question marks, one for each code point."""
    return F.regexp_replace(text, r"[^\x20-\x7E]", "?")


def certificate(results: DataFrame, institution: str = "", mode: str = "copy", timestamps_reset: bool = False) -> str:
    """The batch's certificate as JSON. Its one list grows with the batch; file_records is the same as a table, for batches too large to hold."""
    stats = batch_stats(results).first().asDict()
    verified = results.agg(F.count_if("verified").alias("verified"), F.coalesce(F.sum("cleared"), F.lit(0)).alias("findings")).first().asDict()
    document = {
        "version": VERSION,
        "id": results.sparkSession.sql("SELECT uuid() AS id").first()["id"],
        "generated_at": datetime.now(UTC).isoformat(),
        "institution": institution,
        "mode": mode,
        "summary": stats | verified,
        "measures": [r.asDict() for r in measures(results, timestamps_reset).collect()],
        "files": [json.loads(r[0]) for r in file_records(results).toLocalIterator()],
    }
    return json.dumps(document, indent=2)


def file_records(results: DataFrame) -> DataFrame:
    """One JSON text per file, empty fields left out."""
    return results.select(F.to_json(F.struct(*(c for c in results.columns)), {"ignoreNullFields": "true"}).alias("record"))


def markdown(title: str, summary: dict, rows: list[dict]) -> str:
    """A report for people: a summary and a table."""
    lines = [f"# {title}", "", *(f"- {k}: {v}" for k, v in summary.items()), ""]
    if rows:
        names = list(rows[0])
        lines += ["| " + " | ".join(names) + " |", "|" + "-|" * len(names), *("| " + " | ".join(str(r[n]) for n in names) + " |" for r in rows)]
    return "\n".join(lines) + "\n"
