"""SimHash near-dedup by meet-in-the-middle ball hashing.

A document's fingerprint is the bitwise majority of the hashes of its word shingles. Two fingerprints within `radius` bits
have a point in common that is within half the radius of each, so every distinct fingerprint emits all points of its half-radius ball,
the points are shuffled, and fingerprints that meet in a point are linked after their exact distance is verified.

What keeps it bounded: equal fingerprints are merged first, so one point is met by no more fingerprints than its ball
holds (2,081 for radius 4); points travel packed, eight bytes each, in one binary row for each bucket and block of fingerprints;
buckets grow in number with the fingerprints; and the point space is shuffled in `rounds` parts (a power of two), whose shuffle files are
dropped one after the other. Within a point only links to its smallest fingerprint are made, and of a task's links a spanning forest is kept, not all pairs: fingerprints that share a point are
within the radius of one another. Components are then found by distributed contraction.

Defined cases: null or empty text, or a text without words, has fingerprint 0 and is linked like any other; texts of fewer
words than the shingle size have one shingle, the whole sequence; repeated rows are returned as often as they occur; a
null id is returned but never names a component unless all its ids are null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, staged

SHINGLE = 4
RADIUS = 4
SEED = 42
ROUNDS = 4
#: Points for each bucket at most, on average; 8 bytes each.
BUCKET_POINTS = 4_000_000
#: Up to so many points are shuffled in one round.
SMALL_POINTS = 30_000_000
#: Links that one task merges.
MERGE_PAIRS = 500_000
#: Fingerprints that are expanded at once.
BLOCK = 1024
#: Fingerprints of a view whose block keys one task combines before they are shuffled.
KEY_BLOCK = 65_536
#: Block keys for each bucket at most, on average; 8 bytes each.
BUCKET_KEYS = 1_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_UNDO = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def shingle_hashes(text: bytes | None, size: int, seed: int) -> np.ndarray:
    """XXH64 of every word shingle, repeats included; empty without words."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[a:z], seed) for a, z in zip(starts, ends[size - 1 :].tolist(), strict=False)])
    return np.frombuffer(raw, ">u8").astype(np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit b is 1 if it is set in over half the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):  # so a very long text needs little memory
        bits = np.unpackbits(hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = SHINGLE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(shingle_hashes(t, size, seed)) for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.array(fps, np.uint64).view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp long")


def ball(radius: int) -> np.ndarray:
    """All masks of at most radius bits."""
    return np.array([sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(64), r)], np.uint64)


def packed_points(fps: DataFrame, half: int, bits: int, part: int, parts: int) -> DataFrame:
    """(bucket, points) for one of `parts` equal parts of the point space. A point is hashed by an odd factor, which can be undone;
    the bucket is the upper `bits` bits of the hash. Packed, a point is its lower 52 bits and the index of the mask that made it."""
    masks = ball(half)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = np.arange(len(masks), dtype=np.uint64)[None, :]
        for b in batches:
            every = b.column("fp").to_numpy().view(np.uint64)
            for at in range(0, len(every), BLOCK):
                with np.errstate(over="ignore"):
                    mixed = (every[at : at + BLOCK, None] ^ masks[None, :]) * _ODD
                points = (mixed << np.uint64(12)) | index
                bucket = (mixed >> np.uint64(64 - bits)).astype(np.uint32)
                if parts > 1:
                    chosen = (bucket & np.uint32(parts - 1)) == part
                    points, bucket = points[chosen], bucket[chosen]
                points, bucket = points.ravel(), bucket.ravel()
                order = np.argsort(bucket.astype(np.uint16) if bits <= 16 else bucket, kind="stable")
                points, bucket = points[order], bucket[order]
                cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
                raw = points.tobytes()
                blobs = [raw[8 * x : 8 * y] for x, y in zip(cuts, cuts[1:], strict=False) if y > x]
                names = bucket[[x for x, y in zip(cuts, cuts[1:], strict=False) if y > x]].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(blobs, pa.binary())], ["bucket", "points"])

    return fps.select("fp").mapInArrow(run, "bucket int, points binary")


def bucket_links(bucket: int, blobs: list[bytes], bits: int, masks: np.ndarray, radius: int) -> np.ndarray:
    """(n, 2) of the fingerprints that meet in a point of this bucket, linked to the point's smallest; verified, each pair once."""
    points = np.concatenate([np.frombuffer(x, np.uint64) for x in blobs])
    points.sort()
    low = points >> np.uint64(12)
    new = np.concatenate([[True], low[1:] != low[:-1]])
    alone = new & np.append(new[1:], True)
    points, low, new = points[~alone], low[~alone], new[~alone]
    if not len(points):
        return np.empty((0, 2), np.uint64)
    with np.errstate(over="ignore"):
        mixed = (np.uint64(bucket >> (bits - 12)) << np.uint64(52)) | low
        fps = (mixed * _UNDO) ^ masks[(points & np.uint64(0xFFF)).astype(np.int64)]
    starts = np.flatnonzero(new)
    first = np.repeat(np.minimum.reduceat(fps, starts), np.diff(np.append(starts, len(fps))))
    linked = (first != fps) & (np.bitwise_count(first ^ fps) <= radius)
    a, b = first[linked], fps[linked]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return np.stack([a[fresh], b[fresh]], 1)


def forest(pairs: np.ndarray) -> np.ndarray:
    """As few of the pairs as connect what all of them connect."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    kept = []
    for i, (a, b) in enumerate(pairs.tolist()):
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
            kept.append(i)
    return pairs[kept]


def links(fps: DataFrame, n_fps: int, radius: int = RADIUS, rounds: int = ROUNDS) -> DataFrame:
    """(a, b): a set of pairs of distinct fingerprints within the radius that connects all that are."""
    masks = ball(radius // 2)
    if len(masks) > 4096:
        raise ValueError("a radius of over 5 bits makes balls too large to emit")
    points = n_fps * len(masks)
    bits = min(28, max(12, int(np.ceil(np.log2(max(1, points / BUCKET_POINTS))))))
    rounds = 1 if points <= SMALL_POINTS else rounds

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition's buckets come sorted, so one is held at a time."""
        name, held, found = None, [], []

        def out() -> pa.RecordBatch:
            both = forest(np.concatenate(found))
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array([both.tobytes()], pa.binary()), pa.array([len(both)], pa.int64())], ["pairs", "n"])

        for b in batches:
            for bucket, blob in zip(b.column("bucket").to_pylist(), b.column("points").to_pylist(), strict=True):
                if bucket != name and held:
                    found.append(bucket_links(name, held, bits, masks, radius))
                    held.clear()
                name = bucket
                held.append(blob)
            if sum(map(len, found)) > 100_000:
                yield out()
        if held:
            found.append(bucket_links(name, held, bits, masks, radius))
        if found:
            yield out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = [np.frombuffer(x, np.uint64).reshape(-1, 2) for b in batches for x in b.column("pairs").to_pylist()]
        if both:
            kept = forest(np.concatenate(both)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(kept[:, 0]), pa.array(kept[:, 1])], ["a", "b"])

    found = None
    for part in range(rounds):
        dealt = packed_points(fps, radius // 2, bits, part, rounds).repartition(F.col("bucket")).sortWithinPartitions("bucket")
        own = staged(dealt.mapInArrow(meet, "pairs binary, n long"), "links")
        found = own if found is None else found.unionByName(own)
    # a group of many near copies meets in every task: the forests of all tasks are merged, so many pairs at a time, before they are rows
    pairs = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return staged(found.repartition(max(1, -(-pairs // MERGE_PAIRS))).mapInArrow(merge, "a long, b long").distinct(), "links")


def classes(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS, seed: int = SEED, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) of every document."""
    each = staged(fingerprints(docs, size, seed, id_col, text_col), "fingerprints")
    distinct = staged(each.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    n = distinct.count()
    edges = links(distinct.repartition(max(12, n // (8 * BLOCK))), n, radius, rounds)
    roots = components(edges)
    # a fingerprint without links is its own root
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = staged(rooted, "roots")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = rooted.join(named, "root").select("fp", "component_id")
    return each.join(of_fp, "fp").select("id", "fp", "component_id")


def _remixed(hashes: np.ndarray, view: int) -> np.ndarray:
    """The hashes themselves in view 0, else as if of another hash function."""
    if not view:
        return hashes
    with np.errstate(over="ignore"):
        x = hashes ^ (np.uint64(view) * _ODD)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def block_masks(radius: int) -> np.ndarray:
    """Masks of radius of 2 * radius blocks of the 64 bits: two values that differ in radius bits at most agree in all bits of at least one mask."""
    n = max(2, 2 * radius)
    blocks = [(1 << 64 * (i + 1) // n) - (1 << 64 * i // n) for i in range(n)]
    return np.array([sum(x) for x in combinations(blocks, n - radius)], np.uint64)


def _by_view(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, np.ndarray]]:
    """The fingerprints of a partition of (view, fp), up to about so many of one view at a time."""
    held: dict[int, list[np.ndarray]] = {}
    for b in batches:
        view, fp = b.column("view").to_numpy(), b.column("fp").to_numpy().view(np.uint64)
        for v in np.unique(view).tolist():
            held.setdefault(v, []).append(fp[view == v])
            if sum(map(len, held[v])) >= most:
                yield v, np.concatenate(held.pop(v))
    for v, found in held.items():
        yield v, np.concatenate(found)


def with_neighbours(fps: DataFrame, n_fps: int, radius: int) -> DataFrame:
    """Of the distinct (view, fp), all that can have another of their view within the radius, and a few others: those that share a block key.

    Balls are large, keys are few, and most fingerprints have no neighbour. A task keeps one fingerprint of each key, as the others of
    the key are known to share it, so a key comes from each task once, however many fingerprints have it."""
    masks = block_masks(radius)
    sub = max(3, int(np.ceil(np.log2(max(1, n_fps / BUCKET_KEYS)))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for view, every in _by_view(batches, KEY_BLOCK):
            shared = np.zeros(len(every), bool)
            for m, mask in enumerate(masks):
                key = every & mask
                with np.errstate(over="ignore"):
                    mixed = key * _ODD
                order = np.argsort(mixed)  # an odd factor keeps keys apart, and its upper bits name the bucket
                mixed = mixed[order]
                new = np.concatenate([[True], mixed[1:] != mixed[:-1]])
                shared[order[~(new & np.append(new[1:], True))]] = True
                own, part = every[order[new]], (mixed[new] >> np.uint64(64 - sub)).astype(np.int64)
                cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
                names = ((view * len(masks) + m) << sub) + part[cuts[:-1]]
                blobs = [own[x:z].tobytes() for x, z in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(blobs, pa.binary())], ["bucket", "fps"])
            known = every[shared]
            if len(known):  # negative buckets hold what needs no other task
                yield pa.RecordBatch.from_arrays([pa.array([-1 - view - (int(known[0] % 4096) << 16)]), pa.array([known.tobytes()], pa.binary())], ["bucket", "fps"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, found = None, [], {}

        def close() -> None:
            every = np.concatenate(held)
            held.clear()
            if name < 0:
                view = (-1 - name) & 0xFFFF
            else:
                view, m = divmod(name >> sub, len(masks))
                key = every & masks[m]
                order = np.argsort(key)
                key, every = key[order], every[order]
                new = np.concatenate([[True], key[1:] != key[:-1]])
                every = every[~(new & np.append(new[1:], True))]
            found.setdefault(view, []).append(every)

        def out() -> Iterator[pa.RecordBatch]:
            for view, each in found.items():
                own = np.unique(np.concatenate(each)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), view, np.int32)), pa.array(own)], ["view", "fp"])
            found.clear()

        for b in batches:
            for bucket, blob in zip(b.column("bucket").to_pylist(), b.column("fps").to_pylist(), strict=True):
                if bucket != name and held:
                    close()
                name = bucket
                held.append(np.frombuffer(blob, np.uint64))
            if sum(len(x) for each in found.values() for x in each) > 1_000_000:
                yield from out()
        if held:
            close()
        yield from out()

    dealt = fps.select("view", "fp").repartition(max(12, n_fps // KEY_BLOCK)).mapInArrow(deal, "bucket long, fps binary")
    return dealt.repartition(F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(meet, "view int, fp long").distinct()


def view_links(fps: DataFrame, n_fps: int, views: int, radius: int = RADIUS, rounds: int = ROUNDS) -> DataFrame:
    """(view, a, b): as links(), for the distinct (view, fp) of all views in the same jobs. Only fingerprints that share a block key are expanded.

    A round holds as many points at most as one of `rounds` rounds of a single view would without that choice."""
    masks = ball(radius // 2)
    if len(masks) > 4096:
        raise ValueError("a radius of over 5 bits makes balls too large to emit")
    near = staged(with_neighbours(fps, n_fps, radius), "near")
    n = near.count()
    points = n * len(masks)
    bits = min(26, max(12, int(np.ceil(np.log2(max(1, points / BUCKET_POINTS))))))
    parts = 1 if points <= SMALL_POINTS else 2 ** max(0, int(np.ceil(np.log2(rounds * n * views / n_fps))))

    def expand(part: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = np.arange(len(masks), dtype=np.uint64)[None, :]
            for view, every in _by_view(batches, BLOCK):
                for at in range(0, len(every), BLOCK):
                    with np.errstate(over="ignore"):
                        mixed = (every[at : at + BLOCK, None] ^ masks[None, :]) * _ODD
                    points = (mixed << np.uint64(12)) | index
                    bucket = (mixed >> np.uint64(64 - bits)).astype(np.uint32)
                    chosen = (bucket & np.uint32(parts - 1)) == part
                    points, bucket = points[chosen], bucket[chosen]
                    if not len(points):
                        continue
                    order = np.argsort(bucket.astype(np.uint16) if bits <= 16 else bucket, kind="stable")
                    points, bucket = points[order], bucket[order]
                    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
                    blobs = [points[x:z].tobytes() for x, z in zip(cuts, cuts[1:], strict=False)]
                    names = (view << bits) + bucket[cuts[:-1]].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(blobs, pa.binary())], ["bucket", "points"])

        return run

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, found = None, [], {}

        def close() -> None:
            view, bucket = name >> bits, name & ((1 << bits) - 1)
            found.setdefault(view, []).append(bucket_links(bucket, held, bits, masks, radius))
            held.clear()

        def out() -> Iterator[pa.RecordBatch]:
            for view, pairs in found.items():
                both = forest(np.concatenate(pairs))
                yield pa.RecordBatch.from_arrays([pa.array([view], pa.int32()), pa.array([both.tobytes()], pa.binary()), pa.array([len(both)], pa.int64())], ["view", "pairs", "n"])
            found.clear()

        for b in batches:
            for bucket, blob in zip(b.column("bucket").to_pylist(), b.column("points").to_pylist(), strict=True):
                if bucket != name and held:
                    close()
                name = bucket
                held.append(blob)
            if sum(len(x) for pairs in found.values() for x in pairs) > 100_000:
                yield from out()
        if held:
            close()
        yield from out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for view, x in zip(b.column("view").to_pylist(), b.column("pairs").to_pylist(), strict=True):
                both.setdefault(view, []).append(np.frombuffer(x, np.uint64).reshape(-1, 2))
        for view, pairs in both.items():
            kept = forest(np.concatenate(pairs)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kept), view, np.int32)), pa.array(kept[:, 0]), pa.array(kept[:, 1])], ["view", "a", "b"])

    spread = near.repartition(max(12, n // (8 * BLOCK)))
    found = None
    for part in range(parts):
        dealt = spread.mapInArrow(expand(part), "bucket long, points binary").repartition(F.col("bucket")).sortWithinPartitions("bucket")
        own = staged(dealt.mapInArrow(meet, "view int, pairs binary, n long"), "links")
        found = own if found is None else found.unionByName(own)
    pairs = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return staged(found.repartition(max(1, -(-pairs // MERGE_PAIRS))).mapInArrow(merge, "view int, a long, b long").distinct(), "links")


#: Bits for each view in which linked documents differ at most, over all their fingerprints together. Texts of a five-word similarity of 0.8 differ in up
#: to 8 of 64 bits of two-word fingerprints on average; from 9 on, texts below 0.5 begin.
BITS_A_VIEW = 8.84


def dedup(docs: DataFrame, size: int = 2, views: int = 6, radius: int = RADIUS, seed: int = SEED, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group of near-duplicates, that of the smallest id.

    A copy with a few edits is within 4 bits of its original only now and then, so several independent fingerprints (views) are taken, of
    two-word shingles by default, and documents that are linked in any of them are in one group. A pair that collides in one view is verified by the distance of all its fingerprints, as
    one of 64 bits can be near by chance. All views share their jobs.

    Defined cases: null and empty texts, and texts without words, have equal fingerprints and are one group; rows without an id all stay; of several rows of
    the id that stays, one stays; all columns are returned, whatever their names; an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = []
            for t in b.column("text").cast(pa.binary()).to_pylist():
                h = shingle_hashes(t, size, seed)
                fps.append([fingerprint(_remixed(h, v)) for v in range(views)])
            flat = pa.array(np.array(fps, np.uint64).view(np.int64).reshape(-1))
            cut = pa.array(np.arange(0, len(fps) * views + 1, views, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(cut, flat)], ["id", "fps"])

    kind = docs.schema[id_col].dataType.simpleString()
    named = docs.where(F.col(id_col).isNotNull())
    each = named.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fps array<long>")
    # documents that agree in all views are one node, named by its smallest id
    nodes = staged(each.groupBy("fps").agg(F.min("id").alias("node")), "nodes")
    own = nodes.select("node", "fps", F.posexplode("fps").alias("view", "fp"))
    reps = own.groupBy("view", "fp").agg(F.min("node").alias("rep"), F.count("*").alias("n"))
    reps = staged(reps.join(nodes.select(F.col("node").alias("rep"), F.col("fps").alias("rep_fps")), "rep"), "reps")
    near = view_links(reps, max(1, reps.count()), views, radius, rounds)
    ra, rb = (reps.select("view", F.col("fp").alias(c), F.col("rep").alias(f"r{c}"), F.col("rep_fps").alias(f"f{c}")) for c in "ab")
    linked = near.join(ra, ["view", "a"]).join(rb, ["view", "b"]).select(F.col("ra").alias("a"), F.col("rb").alias("b"), "fa", "fb")
    same = own.join(reps.where("n > 1").select("view", "fp", "rep", "rep_fps"), ["view", "fp"]).where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"), F.col("rep_fps").alias("fa"), F.col("fps").alias("fb"))
    apart = F.expr("aggregate(zip_with(fa, fb, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")
    edges = linked.unionByName(same).where(apart <= int(BITS_A_VIEW * views)).select("a", "b")
    roots = components(edges.distinct()).where("node <> root").select("node")
    kept = staged(nodes.select("node").join(roots, "node", "left_anti"), "kept").select(F.col("node").alias("_kept"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"))
    left = rows.where(F.col("_id").isNotNull()).join(kept.hint("shuffle_hash"), F.col("_id") == F.col("_kept"), "left_semi")
    return left.dropDuplicates(["_id"]).select("_row").unionByName(rows.where(F.col("_id").isNull()).select("_row")).select("_row.*")
