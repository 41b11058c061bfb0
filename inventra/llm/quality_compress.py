"""Quality classifier by compression.

Two zstandard dictionaries are built, one from good and one from bad labelled text. A text is cut into chunks, each
compressed with both; how much larger the whole is with the bad dictionary, over its length, is the normalised
compressed-size difference. Chunks are short so that a long text cannot serve as its own dictionary. A monotone curve, fitted on labelled
documents that neither dictionary has seen, turns the difference into a probability.

Labels are learned from a bounded sample (PER_CLASS documents of a label, of MAX_CHARS characters at most, whole).
Defined cases: null or empty text has difference 0 and so the curve's middle score; without both labels there is nothing to
learn and every score is the share of good labels (1 without any); repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, labelled_sample

PER_CLASS = 3000
MAX_CHARS = 20_000
HELD_OUT = (5, (0,))
CHUNK = 1024
DICT_BYTES = 32_768
LEVEL = 3
#: Bytes that are added to a length, so that a few words decide little.
PRIOR = 50
THRESHOLD = 0.3


class Model(NamedTuple):
    good: bytes
    bad: bytes
    knots: list[float]
    values: list[float]


def _compressors(model: Model) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
    both = []
    for raw in (model.good, model.bad):
        d = zstandard.ZstdCompressionDict(raw)
        d.precompute_compress(level=LEVEL)
        both.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    return both[0], both[1]


def difference(text: bytes | None, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> float:
    if not text:
        return 0.0
    total = 0
    for at in range(0, len(text), CHUNK):
        piece = text[at : at + CHUNK]
        total += len(bad.compress(piece)) - len(good.compress(piece))
    return total / (len(text) + PRIOR)


def _dictionary(texts: list[bytes]) -> bytes:
    chunks = [t[at : at + CHUNK] for t in texts for at in range(0, len(t), CHUNK)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, chunks, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little text: the text itself serves
        return b"".join(chunks)[-DICT_BYTES:]


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, least: int = 15) -> tuple[list[float], list[float]]:
    """Monotone calibration: pooled adjacent violators over steps of at least so many documents, as knots to interpolate between."""
    order = np.argsort(x, kind="stable")
    x, y, weight = x[order], y[order], weight[order]
    pools: list[list[float]] = []  # sum of weights, of weighted labels, of weighted x
    for at in range(0, len(x), least):
        own = slice(at, at + least)
        w = weight[own]
        pools.append([w.sum(), (w * y[own]).sum(), (w * x[own]).sum()])
        while len(pools) > 1 and pools[-2][1] / pools[-2][0] >= pools[-1][1] / pools[-1][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    low = 0.5 / weight.sum() * weight.mean()
    knots = [p[2] / p[0] for p in pools]
    values = [min(1 - low, max(low, p[1] / p[0])) for p in pools]
    # beyond the outer knots the score goes on to 0 and 1
    span = max(1e-6, float(x[-1] - x[0]))
    return [knots[0] - span, *knots, knots[-1] + span], [values[0] / 2, *values, (1 + values[-1]) / 2]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    sample = labelled_sample(docs, labels, "quality", PER_CLASS, MAX_CHARS, HELD_OUT, id_col, text_col)
    good, bad = ([t.encode() for _, t, y in sample if y == label] for label in (1, 0))
    if len(good) < 2 or len(bad) < 2:
        share = (len(good) + 1e-9) / (len(good) + len(bad) + 1e-9)
        return Model(b"good", b"bad", [0.0], [share])
    # every second document for the dictionaries, the others for the curve
    model = Model(_dictionary(good[::2]), _dictionary(bad[::2]), [], [])
    both = _compressors(model)
    x = np.array([difference(t, *both) for own in (good[1::2], bad[1::2]) for t in own])
    y = np.array([1.0] * len(good[1::2]) + [0.0] * len(bad[1::2]))
    # the sample has as many of each label as it can; the curve is for their shares among all labels
    n, out = HELD_OUT
    seen = labels.where(~crc_mod(F.col(id_col), n).isin(*out, -1)).groupBy(F.col("quality").cast("int").alias("q")).count().where(F.col("q").isin(0, 1))
    share = {r["q"]: r["count"] for r in seen.collect()}
    weight = np.where(y == 1, share[1] / len(good[1::2]), share[0] / len(bad[1::2]))
    knots, values = _curve(x, y, weight / weight.mean())
    return model._replace(knots=knots, values=values)


def _scores(texts: list[bytes | None], model: Model, both: tuple) -> np.ndarray:
    x = np.array([difference(t, *both) for t in texts])
    return np.interp(x, model.knots, model.values)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _compressors(model)
        for b in batches:
            s = _scores(b.column("_text").cast(pa.binary()).to_pylist(), model, both)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    n, out = HELD_OUT
    rows = docs.select(F.col(id_col).alias("doc_id"), crc_mod(F.col(id_col), n).isin(*out).alias("held_out"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are predicted to be good, with all their columns."""
    model = fit(docs, labels, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _compressors(model)
        for b in batches:
            s = _scores(pc.cast(b.column(text_col), pa.binary()).to_pylist(), model, both)
            yield b.filter(pa.array(s >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
