"""Language identification by string kernels.

Two texts are compared by the character n-grams (1 to 4, lower-cased, anything but letters as one space) that both
hold, whatever their counts: the blended-spectrum presence kernel, normalised to 1 for equal texts. N-grams are
hashed to BITS bits. Nyström landmarks, an even sample of each language, span the feature space; one-versus-rest
kernel ridge regression is fitted on the kernel rows of a bounded sample of labelled texts. As the decision is
linear in the kernel, landmarks, whitening and ridge weights fold into one matrix, and a batch of texts is scored
by one product of its presence matrix (in sparse form) with it.

Texts never leave the executors for the fit but as landmarks' n-gram sets and kernel rows, both of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sablelens.llm.common import bounded_batches, lean, saved, unit

GRAMS, BITS = 4, 17
#: Bounds of the labelled sample: rows in all, split evenly over the languages, and landmarks among them.
SAMPLE_ROWS, LANDMARKS = 4000, 200
RIDGE, SHARPNESS = 1e-2, 4.0
UNKNOWN = "und"
#: Odd multipliers of the n-gram hash.
STEP, SPREAD = np.uint32(0x01000193), np.uint32(0x9E3779B1)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class Grams:
    """The hashed n-grams of texts; keeps its scratch table."""

    def __init__(self):
        self.seen = np.zeros(1 << BITS, bool)

    def of(self, text: str | None) -> np.ndarray | None:
        """Sorted distinct n-gram numbers, or None for a text without letters."""
        if not text:
            return None
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        letter = _letters()[codes]
        if not letter.any():
            return None
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # the first of each run of other characters stays, as the space behind a word
        codes = np.where(letter, codes, 32)[keep].astype(np.uint32)
        codes = np.concatenate([np.array([32], np.uint32), codes])
        h = np.zeros(len(codes), np.uint32)
        seen = self.seen
        for n in range(1, GRAMS + 1):
            if len(codes) < n:
                break
            h = (h[: len(codes) - n + 1] if n == 1 else h[:-1]) * STEP + codes[n - 1 :] + np.uint32(n)
            seen[(h * SPREAD) >> np.uint32(32 - BITS)] = True
        found = np.flatnonzero(seen)
        seen[found] = False
        return found.astype(np.int32)


@dataclass(frozen=True)
class Model:
    """labels; column: number of an n-gram's row in weights, or -1; weights: n-grams x labels; bias."""

    labels: tuple[str, ...]
    column: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def decisions(self, grams: list[np.ndarray]) -> np.ndarray:
        """Texts x labels: one sparse matrix product for the batch. Each label by itself was fitted to 1 for its texts and -1 for others."""
        rows = [self.column[g] for g in grams]
        rows = [r[r >= 0] for r in rows]
        sizes = np.array([len(r) for r in rows])
        flat = np.concatenate([*rows, np.zeros(1, np.int64)])  # reduceat needs a row at every start
        starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        sums = np.add.reduceat(self.weights[flat], starts, axis=0)[:-1]  # the last start is that of the row added
        sums[sizes == 0] = 0
        return sums / np.sqrt([max(1, len(g)) for g in grams])[:, None] + self.bias


def scores(decisions: np.ndarray) -> np.ndarray:
    """Numbers from 0 to 1, of a sum of 1 for each text."""
    e = np.exp(SHARPNESS * (decisions - decisions.max(axis=1, keepdims=True)))
    return e / e.sum(axis=1, keepdims=True)


def held_out(doc_id: str) -> Column:
    """crc32 of the id as text, modulo 3, is 1; false for null ids, which are not learned from either."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams = Grams()
    for batch in batches:
        found = [grams.of(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), batch.column("rank"), pa.array([None if g is None else g.tobytes() for g in found], pa.binary())], names=["lang", "rank", "grams"]
        )


def _kernel_rows(table: np.ndarray, norms: np.ndarray, column: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                g = grams.of(text)
                if g is None:
                    out.append(None)
                    continue
                rows = column[g]
                both = table[rows[rows >= 0]].sum(axis=0, dtype=np.float32)
                out.append((both / (np.sqrt(len(g)) * norms)).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(out, pa.binary())], names=["lang", "row"])

    return run


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample_rows: int = SAMPLE_ROWS, landmarks: int = LANDMARKS) -> Model | None:
    """Learn from texts and labels of rows that are not held out; None where nothing is labelled.

    Rows without a text, a label or an id are not learned from. Which rows are sampled goes by a hash of the id, so that
    reruns agree; repeated rows are samples like others. Extra columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id))
    counts = saved(known.groupBy(F.col(lang).alias("_l")).agg(F.count("*").alias("_n")), "op10-langs")
    langs = counts.count()
    if not langs:
        return None
    each = max(2, sample_rows // langs)
    # The rows of least hash per language. A first cut by the hash leaves some twice as many as are wanted, so that no
    # task ranks all rows of a frequent language.
    hashed = known.select(F.col(lang).alias("lang"), F.col(doc_id).alias("id"), unit(F.lit("op10"), doc_id).alias("_h"))
    few = hashed.join(counts, F.col("lang") == F.col("_l")).where(F.col("_h") * F.col("_n") < 2 * each + 50)
    order = Window.partitionBy("lang").orderBy("_h", "id")
    picked = few.select("lang", "id", F.row_number().over(order).alias("rank")).where(F.col("rank") <= each)
    picked = saved(picked, "op10-picked")
    rows = known.select(F.col(lang).alias("_l"), F.col(doc_id).alias("_i"), F.col(text).alias("text"))
    # Broadcast: at most sample_rows narrow rows (or two per language).
    sample = rows.join(F.broadcast(picked), (F.col("_i") == F.col("id")) & (F.col("_l") == F.col("lang"))).select("lang", "rank", "text")
    sample = saved(sample, "op10-sample")
    sets = sample.where(F.col("rank") <= max(2, landmarks // langs)).mapInArrow(lean(_sets), "lang string, rank int, grams binary").where("grams IS NOT NULL")
    marks = [np.frombuffer(r["grams"], np.int32) for r in sets.orderBy("lang", "rank").collect()]
    if not marks:
        return None
    names = np.unique(np.concatenate(marks))
    column = np.full(1 << BITS, -1, np.int64)
    column[names] = np.arange(len(names))
    table = np.zeros((len(names), len(marks)), np.uint8)
    for k, g in enumerate(marks):
        table[column[g], k] = 1
    norms = np.sqrt([len(g) for g in marks]).astype(np.float32)
    learned = sample.repartition(max(1, min(16, sample_rows // 250)), "rank").mapInArrow(lean(_kernel_rows(table, norms, column)), "lang string, row binary").where("row IS NOT NULL").orderBy("lang", "row").collect()
    kernel = np.stack([np.frombuffer(r["row"], "<f4") for r in learned]).astype(np.float64)
    labels = tuple(sorted({r["lang"] for r in learned}))
    aims = np.array([[1.0 if r["lang"] == name else -1.0 for name in labels] for r in learned])
    whole = table.astype(np.float32)
    among = (whole.T @ whole).astype(np.float64) / np.outer(norms, norms)
    values, vectors = np.linalg.eigh(among)
    strong = values > 1e-6 * values[-1]
    white = vectors[:, strong] / np.sqrt(values[strong])
    phi = np.hstack([kernel @ white, np.ones((len(kernel), 1))])
    penalty = RIDGE * len(phi) * np.eye(phi.shape[1]) / 10
    penalty[-1, -1] = 1e-9
    beta = np.linalg.solve(phi.T @ phi + penalty, phi.T @ aims)
    folded = (whole / norms) @ (white @ beta[:-1])
    return Model(labels, column, folded.astype(np.float32), beta[-1])


def _predict(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            found = [grams.of(t) for t in batch.column("_text").to_pylist()]
            langs, chances, evidence = [UNKNOWN] * len(found), [0.0] * len(found), [0.0] * len(found)
            if model is not None and (real := [i for i, g in enumerate(found) if g is not None]):
                d = model.decisions([found[i] for i in real])
                best = d.argmax(axis=1)
                for i, k, chance, row in zip(real, best, scores(d), d, strict=True):
                    langs[i], chances[i], evidence[i] = model.labels[k], float(chance[k]), float(row[k] - model.bias[k])
                    if len(model.labels) == 1:  # nothing to tell it from: the share of n-grams that any landmark has
                        evidence[i] = float((model.column[found[i]] >= 0).mean())
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(langs, pa.string()), pa.array(chances, pa.float64()), pa.array(evidence, pa.float64())], names=["_row", "lang_pred", "score", "evidence"])

    return run


def predict(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all by default) and three more, lang_pred, score and evidence, in place of any so named.

    score compares the best language with the others; evidence is what the text's n-grams add to the best one's own decision, 0 for a
    text that shares none with the landmarks, however many languages there are (of a single one it is the share of n-grams known). A text that is null or has no
    letter is `und` with score and evidence 0, as is every text where nothing was learned. Null ids and repeated rows are
    rows like others; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    rest = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score", "evidence")]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("_row"), F.col(text).alias("_text"))
    kind = rows.schema["_row"].dataType.simpleString()
    return rows.mapInArrow(lean(_predict(model)), f"_row {kind}, lang_pred string, score double, evidence double").select("_row.*", "lang_pred", "score", "evidence")


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score, evidence; fitted on rows that are not held out.

    Null ids are kept (and not learned from); repeated rows are each predicted, alike; an empty table gives an
    empty result; extra columns are ignored.
    """
    model = fit(docs, text, lang, doc_id)
    narrow = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("_t"))
    return predict(narrow, model, "_t", ["doc_id", "held_out"])
