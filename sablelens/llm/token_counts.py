"""Token counts with overlap resynchronisation for huge documents.

A document of up to CHUNK code points is encoded whole. A longer one is encoded in chunks that overlap, with the offsets
of their tokens. Two chunks are spliced at a place in their overlap that both have as a token boundary and
that is proven stable (see encoding: a space between two characters that are not white space): tokens before it are
counted in the left chunk, tokens behind it in the right one, and the sum is the library's count of the whole text. Where an
overlap has no such place it is widened, at last to the end of the text. With a vocabulary for which no place is known to be
stable a text of any length is encoded whole, in memory that grows with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sablelens.llm.common import bounded_batches, lean
from sablelens.llm.encoding import Vocabulary, known, vocabulary

#: Code points of a chunk and of the first overlap tried.
CHUNK, OVERLAP = 1 << 15, 256
LIMIT = 1024


def spliced_count(text: str, words: Vocabulary, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """The number of tokens of a text of any length, holding the encodings of two chunks at a time."""
    if len(text) <= chunk or words.stable is None:
        return words.counts([text])[0]
    total, done, begin, wide = 0, 0, 0, overlap
    stop = min(len(text), chunk + wide)
    ours = words.offsets(text[begin:stop]) + begin
    while stop < len(text):
        after = stop - wide
        end = min(len(text), after + chunk + overlap)
        theirs = words.offsets(text[after:end]) + after
        while (at := _common_boundary(text, after, min(stop, end), ours, theirs, words)) is None and stop < len(text):
            wide *= 4
            stop = min(len(text), after + wide)
            ours = words.offsets(text[begin:stop]) + begin
            if end < stop:
                end = min(len(text), stop + chunk)
                theirs = words.offsets(text[after:end]) + after
        if at is None:
            break
        total += int(np.searchsorted(ours, at) - np.searchsorted(ours, done))
        done, begin, stop, ours, wide = at, after, end, theirs, overlap
    return total + len(ours) - int(np.searchsorted(ours, done))


def _common_boundary(text: str, after: int, stop: int, ours: np.ndarray, theirs: np.ndarray, words: Vocabulary) -> int | None:
    """The last stable place in the overlap where both encodings begin a token; not the first one of the right chunk, before which a model may put a space of its own."""
    places = np.array([m.start() for m in words.stable.finditer(text, after + 1, stop)], np.int64)
    # A library may give a token's start with or without its leading space.
    for begun in (ours, theirs):
        places = places[np.isin(places, begun) | np.isin(places + 1, begun)]
    return int(places[-1]) if len(places) else None


def _count(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(tokenizer)
        for batch in batches:
            texts = [t or "" for t in batch.column("_text").to_pylist()]
            short = [i for i, t in enumerate(texts) if len(t) <= CHUNK]
            counts = dict(zip(short, words.counts([texts[i] for i in short]), strict=True))
            made = [counts[i] if i in counts else spliced_count(t, words) for i, t in enumerate(texts)]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("n_bytes"), pa.array(made, pa.int64())], names=["_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", text: str = "text", doc_id: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit.

    Null texts count as empty and have no tokens; null ids are kept; repeated rows are each counted; an empty
    table gives an empty result; extra columns are ignored. `tokenizer` is a path or the name of a public tokenizer.
    """
    bounded_batches(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("_id"), F.octet_length(body).cast("long").alias("n_bytes"), body.alias("_text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    counted = rows.mapInArrow(lean(_count(known(tokenizer))), f"_id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("_id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
