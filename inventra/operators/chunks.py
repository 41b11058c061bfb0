"""Content-defined chunks: gear chunker, chunk index, overlap of objects."""

from __future__ import annotations

import hashlib
import random
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inventra.operators.graph import staged

GEAR_SEED = 0xC0FFEE


def gear_table() -> list[int]:
    rng = random.Random(GEAR_SEED)
    return [rng.getrandbits(64) for _ in range(256)]


#: Bytes that are hashed at once, so the arrays stay in cache.
BLOCK = 1 << 17


def cut_candidates(data: bytes, gear: np.ndarray, bits: tuple[int, ...]) -> list[list[int]]:
    """For each number of bits the positions whose gear hash, the sum of the gears of the bytes up to there, each shifted by its distance, has so many low bits
    zero. Only as many bytes matter as bits are read; windows are built by doubling."""
    most = max(bits)
    kind = np.uint32 if most <= 32 else np.uint64
    table = gear.astype(kind)
    raw = np.frombuffer(data, np.uint8)
    out: list[list[int]] = [[] for _ in bits]
    for at in range(0, len(raw), BLOCK):
        before = min(at, 64)
        h = table[raw[at - before : at + BLOCK]]
        k = 1
        while k < most:
            h[k:] += h[:-k] << kind(k)
            k *= 2
        h = h[before:]
        for found, n in zip(out, bits, strict=True):
            found += (np.flatnonzero(h & kind((1 << n) - 1) == 0) + at).tolist()
    return out


def cut_points(data: bytes, minimum: int, average: int, maximum: int, gear: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, end) of each chunk. A chunk is cut behind the first byte, from the minimum on, where the low bits of the rolling hash are zero (more bits up to
    the average, fewer after it), or at the maximum. The hash starts anew with each chunk, but its low bits depend on fewer bytes than the
    minimum holds, so the candidates of the whole data serve every chunk."""
    average = max(2, average)
    bits = average.bit_length() - 1
    hard, easy = min(63, bits + 2), max(1, bits - 2)
    if minimum < hard:
        raise ValueError("the minimum is too small for the average")
    strict, loose = cut_candidates(data, gear, (hard, easy))
    start, size = 0, len(data)
    while start < size:
        end = min(size, start + maximum)
        middle = min(end, start + average)
        first = bisect_left(strict, start + minimum - 1)
        cut = end
        if first < len(strict) and strict[first] < middle:
            cut = strict[first] + 1
        else:
            first = bisect_left(loose, max(middle, start + minimum - 1))
            if first < len(loose) and loose[first] < end:
                cut = loose[first] + 1
        yield start, cut
        start = cut


def content_chunks(docs: DataFrame, minimum: int = 256, average: int = 1024, maximum: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, seq, offset, size_bytes, chunk_hash) of the content-defined chunks of each object's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gear = np.array(gear_table(), np.uint64)
        digest = hashlib.sha256
        for b in batches:
            rows: list[tuple] = []
            for doc, data in zip(b.column("doc_id").to_pylist(), b.column("data").to_pylist(), strict=True):
                for seq, (a, z) in enumerate(cut_points(data or b"", minimum, average, maximum, gear)):
                    rows.append((doc, seq, a, z - a, digest(data[a:z]).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "seq", "offset", "size_bytes", "chunk_hash"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("data")).mapInArrow(run, "doc_id long, seq long, offset long, size_bytes long, chunk_hash string")


def index(chunks: DataFrame) -> DataFrame:
    """(chunk_hash, size_bytes, occurrences, objects)."""
    return chunks.groupBy("chunk_hash", "size_bytes").agg(F.count("*").alias("occurrences"), F.count_distinct("doc_id").alias("objects"))


def cost(entries: DataFrame, average: int = 65536, row_bytes: int = 64) -> DataFrame:
    """What chunking all distinct contents would cost."""
    objects = entries.where(F.col("full_hash").isNotNull()).select("full_hash", "size_bytes").distinct()
    out = objects.agg(F.count("*").alias("objects"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))
    return out.withColumn("expected_chunks", F.expr(f"bytes div {average} + objects")).withColumn("index_bytes", F.col("expected_chunks") * row_bytes)


def classes(chunks: DataFrame) -> DataFrame:
    """(doc_id, rep, total): rep is the smallest object with the same distinct chunks, total their bytes."""
    sets = chunks.select("doc_id", "chunk_hash", "size_bytes").distinct()
    own = sets.groupBy("doc_id").agg(F.count("*").alias("_n"), F.sum("size_bytes").alias("total"), F.bit_xor(F.xxhash64("chunk_hash")).alias("_x"), F.bit_xor(F.xxhash64(F.lit("second"), "chunk_hash")).alias("_y"))
    reps = own.groupBy("_n", "_x", "_y").agg(F.min("doc_id").alias("rep"))
    return own.join(reps, ["_n", "_x", "_y"]).select("doc_id", "rep", "total")


def overlaps(chunks: DataFrame, minimum_bytes: int = 65536, near: float = 0.9) -> DataFrame:
    """Edges of all objects that share at least minimum_bytes in distinct chunks; exact, without a cap on a chunk's objects. Objects of equal chunks are
    one, named by the smallest (see classes()).

    Chunks are ordered by the number of their objects. The rarest chunk that two objects share is followed by all others they share, so in both it
    stands before the last minimum_bytes; only such chunks are met, and the commonest lines hardly ever are."""
    named = staged(classes(chunks))
    reps = named.where("doc_id = rep").select("doc_id", "total").where(F.col("total") >= minimum_bytes)
    sets = staged(chunks.select("doc_id", "chunk_hash", "size_bytes").distinct().join(reps.select("doc_id"), "doc_id"))
    objects = sets.groupBy("chunk_hash").agg(F.count("*").alias("objects"))
    met = staged(sets.join(objects.where("objects > 1"), "chunk_hash"))
    rest = W.partitionBy("doc_id").orderBy(F.desc("objects")).rangeBetween(W.unboundedPreceding, W.currentRow)
    hist = met.groupBy("doc_id", "objects").agg(F.sum("size_bytes").alias("_b")).withColumn("_rest", F.sum("_b").over(rest)).where(F.col("_rest") >= minimum_bytes)
    seeds = met.join(hist.groupBy("doc_id").agg(F.max("objects").alias("_most")), "doc_id").where("objects <= _most")
    pairs = seeds.select("chunk_hash", F.col("doc_id").alias("a")).join(seeds.select("chunk_hash", F.col("doc_id").alias("b")), "chunk_hash").where("a < b").select("a", "b").distinct()
    side = lambda n: met.select(F.col("doc_id").alias(n), "chunk_hash", *(["size_bytes"] if n == "a" else []))
    shared = pairs.join(side("a"), "a").join(side("b"), ["b", "chunk_hash"]).groupBy("a", "b").agg(F.count("*").alias("shared_chunks"), F.sum("size_bytes").alias("shared_bytes"))
    df = shared.where(F.col("shared_bytes") >= minimum_bytes)
    df = df.join(reps.select(F.col("doc_id").alias("a"), F.col("total").alias("total_a")), "a").join(reps.select(F.col("doc_id").alias("b"), F.col("total").alias("total_b")), "b")
    in_b, in_a = F.col("shared_bytes") / F.col("total_a"), F.col("shared_bytes") / F.col("total_b")
    most = F.greatest(in_b, in_a)
    return df.select("a", "b", "shared_chunks", "shared_bytes", F.round(in_b, 6).alias("a_in_b"), F.round(in_a, 6).alias("b_in_a"), F.round(F.col("shared_bytes") / (F.col("total_a") + F.col("total_b") - F.col("shared_bytes")), 6).alias("jaccard"), F.when(most >= near, "NEAR_SUBSET_CONTENT").otherwise("PARTIAL_CONTENT_OVERLAP").alias("type"))
