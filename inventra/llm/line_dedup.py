"""Line dedup by sorted hashes, returning compressed keep bitmaps.

Every line that has a key becomes a row (hash of the key, document, position), without its text. The rows are
range-partitioned by (hash, document), sorted by (hash, document, position) inside a partition, and streamed once: a run
of equal hashes is one key, and the stream knows which of its lines are first, and when the key has been seen in
min_docs documents. A run that touches an edge of its partition may go on in the next one; its lines are held undecided
and settled by the sums of at most two such runs for each partition, the only thing that is gathered. The
positions to drop become one bitmap for each document, compressed with zlib, and only the bitmaps meet the texts.

keep="none" drops every line of a key that is found in min_docs documents; keep="first" leaves the first one by
(document, position). A document is its (id, text): repeated rows count once and are cleaned alike. Keys are the lines
stripped of [\\x20\\x09-\\x0D] with A-Z lower-cased, told apart by 128 bits; keys of fewer than min_chars code points stay.

Defined cases: null or empty text is one empty line, which has no key; a null id is an id; an empty table gives an empty
result; other columns are kept by clean().
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

MIN_DOCS = 10
MIN_CHARS = 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_rows(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """(hi, lo, id, tk, pos) of every line that has a key."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, texts in _slices(b):
                hi, lo, doc, pos = [], [], [], []
                for n, text in enumerate(texts):
                    if not text:
                        continue
                    for at, line in enumerate(text.split(b"\n")):
                        key = line.strip().lower()
                        if key and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars):
                            d = hashlib.blake2b(key, digest_size=16).digest()
                            hi.append(d[:8])
                            lo.append(d[8:])
                            doc.append(n)
                            pos.append(at)
                longs = [pa.array(np.frombuffer(b"".join(x), dtype=">i8").astype(np.int64)) for x in (hi, lo)]
                at = pa.array(doc, pa.int64())
                yield pa.RecordBatch.from_arrays([*longs, ids.column(0).take(at), ids.column(1).take(at), pa.array(pos, pa.int32())], ["hi", "lo", "id", "tk", "pos"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("tk"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(hashed, f"hi long, lo long, id {kind}, tk long, pos int")


def _slices(batch: pa.RecordBatch, most: int = 16 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The batch in parts of about so many bytes of text."""
    size = pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False)
    if not len(size):
        return
    part = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(size)]
    for a, z in zip(cuts, cuts[1:], strict=False):
        own = batch.slice(a, z - a)
        yield own, own.column("text").cast(pa.binary()).to_pylist()


_STATES = "hi long, lo long, id {kind}, tk long, pos long, part int, state int"
_DROP, _LATER, _FIRST, _SUMMARY = 0, 1, 2, 3


def decisions(rows: DataFrame, min_docs: int, keep: str) -> DataFrame:
    """Streams the sorted rows of each partition. Out come lines to drop (_DROP), lines of an edge run that is open as yet
    (_FIRST of the run here, or _LATER), and one _SUMMARY of each edge run, with its number of documents as pos."""
    every = keep == "none"
    names = [f.name for f in rows.schema.fields]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, seen, leading, part = None, None, 0, True, 0
        held: list = []  # the lines of a run that starts here, until min_docs documents are seen
        out: list = []
        schema = None

        def packed() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        for b in batches:
            if schema is None:
                kinds = [b.schema.field(n).type for n in names]
                schema = pa.schema([*zip(("hi", "lo", "id", "tk"), kinds[:4], strict=True), ("pos", pa.int64()), ("part", pa.int32()), ("state", pa.int32())])
            for hi, lo, doc, tk, pos, part in zip(*(b.column(n).to_pylist() for n in names), strict=True):  # noqa: B007
                starts = (hi, lo) != key
                if starts:
                    if key is not None and leading:
                        out.append((*key, None, None, seen, part, _SUMMARY))
                        leading = False
                    held.clear()  # an inner run of too few documents stays
                    key, last, seen = (hi, lo), None, 0
                if (doc, tk) != last:
                    last, seen = (doc, tk), seen + 1
                if leading:
                    out.append((hi, lo, doc, tk, pos, part, _FIRST if starts else _LATER))
                elif seen < min_docs:
                    held.append((hi, lo, doc, tk, pos, part, _FIRST if starts else _LATER))
                else:
                    out += [(*h[:6], _DROP) for h in held if every or h[6] == _LATER]
                    held.clear()
                    if every or not starts:
                        out.append((hi, lo, doc, tk, pos, part, _DROP))
            if len(out) >= 20_000:
                yield packed()
        if key is not None:  # the last run may go on in the next partition
            out += held
            out.append((*key, None, None, seen, part, _SUMMARY))
        if out:
            yield packed()

    return rows.mapInArrow(stream, _STATES.format(kind=rows.schema["id"].dataType.simpleString()))


def keep_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, keep: str = "none", min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tk, keep_bitmap) of the documents that lose lines. Bit i (most significant first) of the decompressed bitmap is 1 if
    line i stays; lines beyond its end stay."""
    if keep not in ("none", "first"):
        raise ValueError(f"keep must be none or first, not {keep!r}")
    order = ("hi", "lo", "id", "tk")
    rows = line_rows(docs, min_chars, id_col, text_col).repartitionByRange(*order).sortWithinPartitions(*order, "pos")
    found = staged(decisions(rows.withColumn("part", F.spark_partition_id()), min_docs, keep), "lines")
    # at most two rows for each partition, whatever the number of lines
    edges = found.where(F.col("state") == _SUMMARY).groupBy(F.col("hi").alias("_hi"), F.col("lo").alias("_lo")).agg(F.sum("pos").alias("_seen"), F.min("part").alias("_part")).where(F.col("_seen") >= min_docs)
    open_ = found.where(F.col("state").isin(_FIRST, _LATER)).join(F.broadcast(edges), (F.col("hi") == F.col("_hi")) & (F.col("lo") == F.col("_lo")))
    if keep == "first":
        open_ = open_.where((F.col("state") == _LATER) | (F.col("part") != F.col("_part")))
    drops = found.where(F.col("state") == _DROP).select("id", "tk", "pos").unionByName(open_.select("id", "tk", "pos"))
    by_doc = drops.groupBy("id", "tk").agg(F.sort_array(F.collect_set("pos")).alias("drops"))
    return by_doc.select("id", "tk", F.arrow_udf(_bitmap, "binary")("drops").alias("keep_bitmap"))


def _bitmap(drops: pa.Array) -> pa.Array:
    out = []
    for own in drops:
        at = own.values.to_numpy()
        bits = np.ones((int(at[-1]) // 8 + 1) * 8, np.uint8)
        bits[at] = 0
        out.append(zlib.compress(np.packbits(bits).tobytes(), 6))
    return pa.array(out, pa.binary())


def kept_lines(text: bytes | None, bitmap: bytes | None) -> tuple[list[bytes], int]:
    """(lines that stay, number of lines)."""
    lines = (text or b"").split(b"\n")
    if bitmap is None:
        return lines, len(lines)
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))
    return [x for i, x in enumerate(lines) if i >= len(bits) or bits[i]], len(lines)


def _kept_text(text: pa.Array, bitmap: pa.Array) -> pa.Array:
    out = [t if m is None or t is None else b"\n".join(kept_lines(t, m)[0]) for t, m in zip(text.cast(pa.binary()).to_pylist(), bitmap.to_pylist(), strict=True)]
    return pa.array(out, pa.binary()).cast(pa.string())


def _digest(text: pa.Array, bitmap: pa.Array) -> pa.Array:
    total, dropped, sha = [], [], []
    for t, m in zip(text.cast(pa.binary()).to_pylist(), bitmap.to_pylist(), strict=True):
        if m is None:
            kept, n, left = t or b"", (t or b"").count(b"\n") + 1, None
        else:
            left, n = kept_lines(t, m)
            kept = b"\n".join(left)
        total.append(n)
        dropped.append(0 if left is None else n - len(left))
        sha.append(hashlib.sha256(kept).hexdigest())
    return pa.StructArray.from_arrays([pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha, pa.string())], ["n_lines", "n_dropped", "kept_sha256"])


def _with_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_row, keep_bitmap); the bitmaps are the side that is hashed, so texts are shuffled but never sorted."""
    each = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_tk"))
    return each.join(bitmaps.hint("shuffle_hash"), each["_id"].eqNullSafe(bitmaps["id"]) & (each["_tk"] == bitmaps["tk"]), "left").select("_row", "keep_bitmap")


def clean(docs: DataFrame, min_docs: int = MIN_DOCS, keep: str = "none", min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the dropped lines; all other columns as they were (n_chars, if there, follows the text)."""
    joined = _with_bitmaps(docs, keep_bitmaps(docs, min_docs, keep, min_chars, id_col, text_col), id_col, text_col)
    text = F.arrow_udf(_kept_text, "string")(F.col(f"_row.`{text_col}`").cast("string"), F.col("keep_bitmap"))
    done = joined.select(F.col("_row"), text.alias("_new"), F.col("keep_bitmap").isNotNull().alias("_changed"))
    cols = []
    for c in docs.columns:
        old = F.col(f"_row.`{c}`")
        new = F.col("_new") if c == text_col else F.when(F.col("_changed"), F.length("_new").cast(docs.schema[c].dataType)).otherwise(old) if c == "n_chars" else old
        cols.append(new.alias(c))
    return done.select(*cols)


def digests(docs: DataFrame, min_docs: int = MIN_DOCS, keep: str = "none", min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every document."""
    slim = docs.select(id_col, text_col)
    joined = _with_bitmaps(slim, keep_bitmaps(slim, min_docs, keep, min_chars, id_col, text_col), id_col, text_col)
    return joined.select(F.col(f"_row.`{id_col}`").alias("doc_id"), F.arrow_udf(_digest, "n_lines bigint, n_dropped bigint, kept_sha256 string")(F.col(f"_row.`{text_col}`").cast("string"), F.col("keep_bitmap")).alias("_d")).select("doc_id", "_d.*")
