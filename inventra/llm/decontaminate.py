"""Benchmark decontamination with DataFrame operations only.

A document is contaminated by an item if one of its windows, as many words long as the item, has a weighted word-shingle
similarity of SIMILARITY or more with it (five words; a shingle weighs as often as it occurs). Such windows are found by SimHash:

1. A window that reaches the similarity holds 8/9 of an item's number of shingles at least, all of which occur in the benchmark. Windows with fewer
   positions whose shingle is in any item cannot match, and are not fingerprinted; most of a corpus ends here. In the parts that are left,
   the bits of the shingle hashes are summed over the positions, many small counters to a long; the difference of two sums is the 63-bit fingerprint
   of any window, so windows of all item lengths at all starts are fingerprinted at the cost of a few additions each.
2. A multi-index of the items holds, for each of BLOCKS blocks of an item's fingerprint, all values within RADIUS // BLOCKS bits. Two
   fingerprints within RADIUS bits agree to that many bits in one block at least, so a window whose block values are not in the index is within
   the radius of no item. The index is an equi-join on (window size, block, value), behind a bitmap of the values that occur; the Hamming
   distance verifies each (window, item) it yields, and the pair is kept together from there on.
3. The exact similarity is taken over the words of the candidates and of the windows next to them (REACH words either way).

RADIUS is the only inexact step: at the least similarity two fingerprints differ in 10 of 63 bits on average, with a deviation of 3. README has the
recall measured against all windows.

Defined cases: words are runs without [\\x20\\x09-\\x0D], lower-cased; null or empty texts and items have no words and match nothing; an item of fewer
than five words is one shingle, and a document shorter than an item is one window; a document is its (id, text), so repeated rows count
once; items of equal text are all reported; an empty table gives an empty result; other columns are ignored, and kept by clean().
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_SQL, broadcast_if, staged

SHINGLE = 5
SIMILARITY = 0.8
BLOCKS = 5
RADIUS = 19
#: A plateau of equal similarity can reach past the radius; so many starts on either side are verified too.
REACH = 4
#: Bits of a fingerprint: a long without its sign.
BITS = 63
#: Bits of a block at most.
BLOCK_BITS = -(-BITS // BLOCKS)
#: Rows that are broadcast at most; larger sides are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: The same for rows that hold arrays.
BROADCAST_LISTS = 50_000
#: Window sizes whose bitmaps (5 KB each) are broadcast at most.
BROADCAST_SIZES = 1_000


def _words(text: str) -> str:
    return f"regexp_extract_all(lower(coalesce({text}, '')), {WORD_SQL}, 0)"


def _let(value: str, name: str, body: str) -> str:
    """Binds value once; a column would be inlined into inner lambdas."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _position_hashes(size: int) -> str:
    """Of every position of the text, the hash of the shingle that starts there."""
    own = ", ".join(f"h[i + {k}]" if k else "h[i]" for k in range(size))
    return _let(f"transform({_words('_text')}, x -> xxhash64(x))", "h", f"if(size(h) < {size}, cast(array() as array<bigint>), transform(sequence(0, size(h) - {size}), i -> xxhash64({own})))")


#: Shingles of the word array w as strings.
_SHINGLES = f"if(size(w) <= {SHINGLE}, array(array_join(w, ' ')), transform(sequence(0, size(w) - {SHINGLE}), i -> array_join(slice(w, i + 1, {SHINGLE}), ' ')))"
#: Bits that are set in over half the hashes h.
_FINGERPRINT = f"aggregate(sequence(0, {BITS - 1}), 0L, (f, b) -> f | if(2 * aggregate(h, 0, (n, x) -> n + cast(shiftright(x, b) & 1 as int)) > size(h), shiftleft(1L, b), 0L))"
#: Sum of the smaller weights of the shingles of a and b; without repeats that is the size of the intersection.
_COMMON = (
    "if(size(array_distinct(a)) = size(a) and size(array_distinct(b)) = size(b), size(array_intersect(a, b)), "
    "aggregate(array_distinct(a), 0, (n, x) -> n + least(size(filter(a, y -> y = x)), size(filter(b, y -> y = x)))))"
)


def _lanes(width: int) -> int:
    """The lowest bit of each counter of a long."""
    return sum(1 << width * t for t in range(BITS // width))


def _sums(width: int) -> str:
    """array<struct<a0.., hits>> of the hashes h: the counters of their bits summed up to each position, and the positions of ps among them. Counter t
    of field j counts bit t * width + j."""
    zero = ", ".join(f"'a{j}', 0L" for j in range(width))
    step = ", ".join(f"'a{j}', element_at(s, -1).a{j} + (shiftrightunsigned(h[k], {j}) & {_lanes(width)}L)" for j in range(width))
    step += ", 'hits', element_at(s, -1).hits + if(array_contains(ps, k), 1, 0)"
    return f"aggregate(sequence(0, size(h) - 1), array(named_struct({zero}, 'hits', 0)), (s, k) -> concat(s, array(named_struct({step}))))"


def _window_fingerprint(width: int) -> str:
    """From the sums before (z) and after (a) a window: a counter plus an offset reaches its highest bit if it is over half the window's size."""
    top = _lanes(width) << (width - 1)
    parts = [f"shiftrightunsigned((sums[i + m].a{j} - sums[i].a{j} + offset) & {top}L, {width - 1 - j})" for j in range(width)]
    return " | ".join(parts)


def _block_cuts() -> list[tuple[int, int]]:
    return [(BITS * i // BLOCKS, BITS * (i + 1) // BLOCKS) for i in range(BLOCKS)]


def _in_block(fp: str, block: int) -> str:
    a, z = _block_cuts()[block]
    return f"(shiftrightunsigned({fp}, {a}) & {(1 << (z - a)) - 1}L)"


def index_rows(items: DataFrame, radius: int) -> DataFrame:
    """(size, key, item, item_fp): of each item all block values within radius // BLOCKS bits; key is block and value."""
    rows = []
    for k, (a, z) in enumerate(_block_cuts()):
        masks = [sum(1 << b for b in bits) for r in range(radius // BLOCKS + 1) for bits in combinations(range(z - a), r)]
        rows.append(items.select("size", "item", F.col("fp").alias("item_fp"), F.expr(_in_block("fp", k)).alias("v"), F.explode(F.expr(f"array({', '.join(map(str, masks))})")).alias("mask")).select("size", (F.col("v").bitwiseXOR(F.col("mask").cast("long")) + F.lit(k << BLOCK_BITS)).alias("key"), "item", "item_fp"))
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def _bitmaps(index: DataFrame) -> DataFrame:
    """(size, map): one bit for each key that occurs with a window size."""
    words = -(-(BLOCKS << BLOCK_BITS) // 64)
    own = index.select("size", F.shiftright("key", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("bits"))
    none = index.select("size").distinct().select("size", F.explode(F.sequence(F.lit(0), F.lit(words - 1))).alias("word"), F.lit(0).cast("long").alias("bits"))
    each = own.unionByName(none).groupBy("size", "word").agg(F.bit_or("bits").alias("bits"))
    return each.groupBy("size").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("w")).select("size", F.col("w.bits").alias("map"))


def item_rows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, len, width, size, hashes, fp, shingles) of the items that have words: shingles are `width` words, and `size` many."""
    df = benchmark.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("_text"))
    df = df.withColumn("w", F.expr(_words("_text"))).where(F.size("w") > 0)
    hashes = "case " + " ".join(f"when size(w) {'>=' if k == SHINGLE else '='} {k} then {_position_hashes(k)}" for k in range(SHINGLE, 0, -1)) + " end"
    df = df.select("item", F.size("w").alias("len"), F.least(F.size("w"), F.lit(SHINGLE)).alias("width"), F.expr(_let("w", "w", _SHINGLES)).alias("shingles"), F.expr(hashes).alias("h"))
    return staged(df.select("item", "len", "width", F.size("h").alias("size"), F.col("h").alias("hashes"), F.expr(_FINGERPRINT).alias("fp"), "shingles"), "items")


def candidates(docs: DataFrame, items: DataFrame, similarity: float, radius: int, id_col: str, text_col: str) -> DataFrame:
    """(id, tk, item, start): windows whose fingerprint is within the radius of an item's, and that hold as many of its shingles as the similarity takes."""
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("tk"), F.col(text_col).cast("string").alias("_text"))
    found = None
    share = similarity / (1 + similarity)
    sizes: dict[tuple[int, int], list[int]] = {}
    for r in items.select("width", "size").distinct().collect():  # as many as items have lengths
        sizes.setdefault((r["width"], next(w for w in (9, 21, BITS) if 2 * r["size"] < 1 << w)), []).append(r["size"])
    for (width, counters), own_sizes in sorted(sizes.items()):
        most = max(own_sizes)
        chunk = max(64, most)  # with the window's length after it, far below what a counter holds
        own = items.where((F.col("width") == width) & F.col("size").isin(own_sizes))
        # parts of the documents that hold enough of the benchmark; in one expression, as filters that are inferred for a column of hashes would compute it again
        keys = staged(own.select(F.explode("hashes").alias("key")).distinct(), "shingles")
        at = base.select("id", "tk", F.posexplode(F.expr(_position_hashes(width))).alias("p", "key"))
        hits = at.join(broadcast_if(keys, keys.count(), BROADCAST_ROWS), "key").select("id", "tk", "p")
        part = F.expr(f"p div {chunk}").cast("int")
        twice = F.when((part > 0) & (F.col("p") % chunk < most), F.array(part, part - 1)).otherwise(F.array(part))
        parts = hits.select("id", "tk", F.explode(twice).alias("part"), "p").groupBy("id", "tk", "part").agg(F.collect_set(F.col("p") - F.col("part") * chunk).alias("ps"))
        parts = parts.where(F.size("ps") >= similarity * min(own_sizes) - 1e-9)
        marked = staged(parts.groupBy("id", "tk").agg(F.collect_list(F.struct("part", "ps")).alias("parts")), "marked").select(F.col("id").alias("_id"), F.col("tk").alias("_tk"), "parts")
        # their windows
        texts = base.join(broadcast_if(marked, marked.count(), BROADCAST_LISTS), F.col("id").eqNullSafe(F.col("_id")) & (F.col("tk") == F.col("_tk"))).dropDuplicates(["id", "tk"])
        cut = _let(_position_hashes(width), "hs", f"transform(parts, x -> named_struct('start', x.part * {chunk}, 'n', size(hs), 'ps', x.ps, 'h', slice(hs, x.part * {chunk} + 1, {chunk + most})))")
        at = texts.select("id", "tk", F.explode(F.expr(cut)).alias("c")).select("id", "tk", "c.*")
        at = at.select("*", F.size("h").alias("have"), F.expr(_sums(counters)).alias("sums"))
        at = at.select("*", F.explode(F.expr(f"sequence(0, least({chunk}, n - start) - 1)")).alias("i"))
        at = at.select("*", F.explode(F.lit(sorted(own_sizes))).alias("size")).withColumn("m", F.least("size", "n"))
        # a document with fewer shingles than the item is one window
        at = at.where((F.col("i") + F.col("m") <= F.col("have")) & ((F.col("n") >= F.col("size")) | (F.col("start") + F.col("i") == 0)))
        least = F.lit(share) * (F.col("m") + F.col("size")) - F.lit(1e-9)
        at = at.where(F.expr("sums[i + m].hits - sums[i].hits") >= least)
        index = staged(index_rows(own, radius), "index")
        maps = staged(_bitmaps(index), "bitmaps").select(F.col("size").alias("_size"), "map")
        at = at.join(F.broadcast(maps) if len(own_sizes) <= BROADCAST_SIZES else maps, F.col("size") == F.col("_size"))
        at = at.withColumn("offset", F.expr(f"({(1 << (counters - 1)) - 1} - shiftright(m, 1)) * {_lanes(counters)}L"))
        # an explode of one value keeps the filters below from being computed from the expression itself, once for each block
        at = at.select("id", "tk", "start", "i", "m", "h", "map", "size", F.explode(F.array(F.expr(_window_fingerprint(counters)))).alias("fp"))
        bit = lambda key: f"(shiftright(map[cast(shiftright({key}, 6) as int)], cast({key} & 63 as int)) & 1) = 1"
        at = at.select("*", F.explode(F.array(*[F.expr(f"{_in_block('fp', k)} + {k << BLOCK_BITS}L") for k in range(BLOCKS)])).alias("key")).where(bit("key")).drop("map")
        met = at.join(broadcast_if(index, index.count(), BROADCAST_ROWS), ["size", "key"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
        # the shingles of both by hash: no fewer than the similarity takes, so only candidates go on to the text
        held = own.select("item", "hashes")
        met = met.join(broadcast_if(held, held.count(), BROADCAST_LISTS), "item")
        met = met.where(F.size(F.expr("filter(slice(h, i + 1, m), x -> array_contains(hashes, x))")) >= least)
        met = met.select("id", "tk", "item", (F.col("start") + F.col("i")).alias("start"))
        found = met if found is None else found.unionByName(met)
    if found is None:
        return base.select("id", "tk", F.lit(None).cast(items.schema["item"].dataType).alias("item"), F.lit(0).alias("start")).where("false")
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, tk, item, start, similarity): the best window of every contaminated document for each item."""
    items = item_rows(benchmark, item_col, item_text_col)
    near = candidates(docs, items, similarity, radius, id_col, text_col)
    wins = staged(near.groupBy("id", "tk", "item").agg(F.collect_set("start").alias("starts")), "windows")
    lens = items.select("item", "len", F.col("shingles").alias("b"))
    wins = wins.join(broadcast_if(lens, items.count(), BROADCAST_LISTS), "item")
    base = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_tk"), F.col(text_col).cast("string").alias("_text"))
    one = wins.groupBy("id", "tk").agg(F.collect_list(F.struct("item", "len", "b", "starts")).alias("wins"))
    one = staged(one, "laid")
    texts = base.join(broadcast_if(one, one.count(), BROADCAST_LISTS), F.col("_id").eqNullSafe(F.col("id")) & (F.col("_tk") == F.col("tk"))).dropDuplicates(["id", "tk"])
    near_starts = f"array_distinct(flatten(transform(x.starts, p -> transform(sequence(p - {REACH}, p + {REACH}), q -> greatest(0, least(q, size(w) - x.len))))))"
    laid = _let(_words("_text"), "w", f"flatten(transform(wins, x -> transform({near_starts}, p -> named_struct('item', x.item, 'start', p, 'b', x.b, 'w', slice(w, p + 1, x.len)))))")
    each = texts.select("id", "tk", F.explode(F.expr(laid)).alias("x")).select("id", "tk", "x.*")
    scored = each.select("id", "tk", "item", "start", "b", F.expr(_let("w", "w", _SHINGLES)).alias("a")).withColumn("_common", F.expr(_COMMON))
    scored = scored.withColumn("similarity", F.col("_common") / (F.size("a") + F.size("b") - F.col("_common")))
    best = F.max(F.struct(F.col("similarity"), (-F.col("start")).alias("start")))
    return scored.where(F.col("similarity") >= similarity).groupBy("id", "tk", "item").agg(best.alias("x")).select("id", "tk", "item", (-F.col("x.start")).alias("start"), F.col("x.similarity").alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without contamination, with all their columns."""
    bad = staged(contaminated(docs, benchmark, id_col=id_col, text_col=text_col).select(F.col("id").alias("_id"), F.col("tk").alias("_tk")).distinct(), "contaminated")
    each = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_i"), F.xxhash64(F.col(text_col)).alias("_t"))
    kept = each.join(broadcast_if(bad, bad.count(), BROADCAST_ROWS), F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_tk")), "left_anti")
    return kept.select("_row.*")
