"""Language identification by a linear-chain conditional random field over words.

Every word of a text is labelled with a language. A word's evidence is the sum of learned weights of its features: affixes
and n-grams of 2 to 5 bytes (with marks for the word's ends) and the whole word as a lexicon entry, hashed into one table.
Transition weights between the languages of neighbouring words are learned with them, by the gradient of the chain's
likelihood on code-switched sequences: stretches of sampled documents of several languages in a row. Forward-backward gives each
word's posterior; a document's score of a language is their mean, and the best language is predicted.

Forward-backward over a batch is exact and vectorised: all words of the batch are one chain that starts anew at each
document; it is cut into equal pieces, whose transfer matrices are multiplied step by step side by side and then joined.

Every language that labels a document is learned, from a bounded sample of whole documents: PER_LANG of a language, or SAMPLE_DOCS shared evenly
where there are many languages, of MAX_CHARS characters at most. One pass counts the distinct rows of a language by powers of two of a hash, a second reads those of the smallest hashes, about 2 to 4 times the sample.
Defined cases: null text or a text without letters (\\p{L}) is `und` with score 0; without labelled languages every text is
`und`; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if, crc_mod, staged

PER_LANG = 400
#: Documents that are sampled of all languages together, but one of each at least.
SAMPLE_DOCS = 12_800
MAX_CHARS = 10_000
#: Languages up to which the table of their cuts, one short row each, is broadcast.
MAX_BROADCAST = 100_000
HELD_OUT = (3, (1,))
BITS = 16
ORDERS = (2, 3, 4, 5)
STEPS = 40
EPOCHS = 4
BATCH = 128
#: Words after which no further documents of the sample are taken, shared by the languages; a document is taken whole, one of each language at least.
TRAIN_WORDS = 240_000
#: Words that are labelled at once.
PIECE = 400_000
_LETTERS = re.compile(r"[^\W\d_]+")


class Model(NamedTuple):
    langs: list[str]
    table: np.ndarray  # (2**BITS, languages)
    start: np.ndarray
    trans: np.ndarray


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in lower case."""
    found = _LETTERS.findall(text.lower()) if text else []
    if all(map(str.isalpha, found)):
        return found
    # fractions, superscripts and the like are word characters, but no letters
    return [x for w in found for x in "".join(c if c.isalpha() else " " for c in w).split()]


def feature_ids(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed features of all words one after the other, start of each word's)."""
    raw = [w.encode() for w in words]
    buffer = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in raw) + b"\x00" * 8, np.uint8).astype(np.uint32)
    sizes = np.fromiter((len(w) + 2 for w in raw), np.int64, len(raw))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    left = np.repeat(ends, sizes) - np.arange(ends[-1] if len(ends) else 0)  # bytes left in the word, this one included
    owner = np.repeat(np.arange(len(raw)), sizes)
    ids, whose = [], []
    code = np.zeros(len(left), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(max(ORDERS)):
            code = code * np.uint32(0x01000193) + buffer[k : k + len(left)] + np.uint32(k + 1)
            if k + 1 in ORDERS:
                fits = left > k
                mixed = (code[fits] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
                ids.append(mixed)
                whose.append(owner[fits])
    ids.append(np.fromiter((zlib.crc32(w) >> (32 - BITS) for w in raw), np.uint32, len(raw)))
    whose.append(np.arange(len(raw)))
    flat, who = np.concatenate(ids), np.concatenate(whose)
    order = np.argsort(who, kind="stable")
    del starts
    counts = np.bincount(who, minlength=len(raw))
    return flat[order].astype(np.int64), np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)


def emissions(words: Sequence[str], table: np.ndarray) -> np.ndarray:
    """(words, languages) sums of feature weights."""
    out = np.empty((len(words), table.shape[1]), np.float32)
    for at in range(0, len(words), 50_000):
        own = words[at : at + 50_000]
        ids, starts = feature_ids(own)
        out[at : at + len(own)] = np.add.reduceat(table[ids], starts, axis=0)
    return out


def posteriors(emit: np.ndarray, first: np.ndarray, start: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """(words, languages) posteriors of one chain that starts anew where first is true."""
    n, k = emit.shape
    if not n:
        return emit.astype(np.float64)
    e = np.exp(emit - emit.max(1, keepdims=True)).astype(np.float64)
    t, s = np.exp(trans - trans.max()), np.exp(start - start.max())
    length = max(1, int(np.ceil(np.sqrt(n))))
    pieces = -(-n // length)
    pad = pieces * length - n
    e = np.concatenate([e, np.ones((pad, k))]).reshape(pieces, length, k)
    f = np.concatenate([first, np.ones(pad, bool)]).reshape(pieces, length)  # padding is apart from the last document
    f[0, 0] = True
    anew = np.broadcast_to(s, (k, k))

    def step(i: int) -> np.ndarray:
        """Into word i of each piece, from the one before."""
        return np.where(f[:, i, None, None], anew, t)

    def run(v: np.ndarray, i: int) -> np.ndarray:
        v = (v @ step(i)) * e[:, i][:, None, :]
        return v / np.maximum(v.sum(2, keepdims=True), 1e-300)

    # transfer of each piece: row j starts in language j; rows keep their own scale apart
    v = np.broadcast_to(np.eye(k), (pieces, k, k)).copy()
    scale = np.zeros((pieces, k))
    for i in range(length):
        v = (v @ step(i)) * e[:, i][:, None, :]
        z = np.maximum(v.sum(2), 1e-300)
        scale += np.log(z)
        v /= z[:, :, None]
    heads = np.empty((pieces, 1, k))
    now = np.full(k, 1.0 / k)
    for p in range(pieces):
        heads[p, 0] = now
        w = np.log(np.maximum(now, 1e-300)) + scale[p]
        w = np.exp(w - w.max())
        now = w @ v[p]
        now /= now.sum()
    alpha = np.empty((pieces, length, k))
    a = heads
    for i in range(length):
        a = run(a, i)
        alpha[:, i] = a[:, 0]
    # backward: b[i] = step[i + 1] @ (e[i + 1] * b[i + 1]); columns of the piece's transfer to its end
    u = np.broadcast_to(np.eye(k), (pieces, k, k)).copy()
    back = np.zeros((pieces, k))
    for i in range(length - 1, -1, -1):
        u = step(i) @ (e[:, i][:, :, None] * u)
        z = np.maximum(u.sum(1), 1e-300)
        back += np.log(z)
        u /= z[:, None, :]
    tails = np.empty((pieces, k))
    now = np.ones(k)
    for p in range(pieces - 1, -1, -1):
        tails[p] = now
        w = np.log(np.maximum(now, 1e-300)) + back[p]
        w = np.exp(w - w.max())
        now = u[p] @ w
        now /= now.sum()
    beta = np.empty((pieces, length, k))
    b = tails[:, :, None]
    for i in range(length - 1, -1, -1):
        beta[:, i] = b[:, :, 0]
        b = step(i) @ (e[:, i][:, :, None] * b)
        b /= np.maximum(b.sum(1, keepdims=True), 1e-300)
    post = alpha * beta
    post /= np.maximum(post.sum(2, keepdims=True), 1e-300)
    return post.reshape(-1, k)[:n]


def _batch_gradient(emit: np.ndarray, gold: np.ndarray, start: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of the negative log-likelihood of (sequences, steps) for emissions, start and transitions."""
    b, t, k = emit.shape
    e = np.exp(emit - emit.max(2, keepdims=True))
    m, s = np.exp(trans), np.exp(start)
    alpha, beta = np.empty_like(e), np.ones_like(e)
    alpha[:, 0] = s * e[:, 0]
    alpha[:, 0] /= alpha[:, 0].sum(1, keepdims=True)
    for i in range(1, t):
        alpha[:, i] = (alpha[:, i - 1] @ m) * e[:, i]
        alpha[:, i] /= alpha[:, i].sum(1, keepdims=True)
    for i in range(t - 2, -1, -1):
        beta[:, i] = (e[:, i + 1] * beta[:, i + 1]) @ m.T
        beta[:, i] /= beta[:, i].sum(1, keepdims=True)
    post = alpha * beta
    post /= post.sum(2, keepdims=True)
    pair = alpha[:, :-1, :, None] * m * (e * beta)[:, 1:, None, :]
    pair /= pair.sum((2, 3), keepdims=True)
    hot = np.eye(k)[gold]
    seen = np.einsum("bti,btj->ij", hot[:, :-1], hot[:, 1:])
    return post - hot, (post - hot)[:, 0].sum(0), pair.sum((0, 1)) - seen


def train(texts: Sequence[tuple[str, str]], seed: int = 7) -> Model:
    """From (text, language) pairs."""
    langs = sorted({lang for _, lang in texts})
    k = len(langs)
    rng = np.random.default_rng(seed)
    stretches = []
    per_lang = dict.fromkeys(langs, 0)
    for text, lang in texts:
        if per_lang[lang] >= TRAIN_WORDS // max(1, k):
            continue
        words, at = words_of(text), 0
        per_lang[lang] += len(words)
        while at < len(words):
            size = int(rng.integers(3, 40))
            stretches.append((words[at : at + size], langs.index(lang)))
            at += size
    model = Model(langs, np.zeros((1 << BITS, k)), np.zeros(k), np.zeros((k, k)))
    if not stretches or k < 2:
        return model
    rng.shuffle(stretches)
    sequence = [(w, lang) for own, lang in stretches for w in own]
    vocabulary: dict[str, int] = {}
    index = np.array([vocabulary.setdefault(w, len(vocabulary)) for w, _ in sequence])
    gold = np.array([lang for _, lang in sequence])
    ids, starts = feature_ids(list(vocabulary))
    sizes = np.diff(np.append(starts, len(ids)))
    rows = max(1, len(index) // STEPS)
    index, gold = np.resize(index, rows * STEPS).reshape(rows, STEPS), np.resize(gold, rows * STEPS).reshape(rows, STEPS)
    table, start, trans = model.table, model.start, model.trans
    speed = [np.full_like(x, 1e-6) for x in (table, start, trans)]
    for _ in range(EPOCHS):
        order = rng.permutation(rows)
        for at in range(0, rows, BATCH):
            own = order[at : at + BATCH]
            used, local = np.unique(index[own].ravel(), return_inverse=True)
            spans = np.concatenate([np.arange(starts[u], starts[u] + sizes[u]) for u in used])
            own_ids, own_starts = ids[spans], np.concatenate([[0], np.cumsum(sizes[used])[:-1]])
            emit = np.add.reduceat(table[own_ids], own_starts, axis=0)[local].reshape(len(own), STEPS, k)
            g_emit, g_start, g_trans = _batch_gradient(emit, gold[own], start, trans)
            per_word = np.zeros((len(used), k))
            np.add.at(per_word, local.ravel(), g_emit.reshape(-1, k))
            touched, where = np.unique(own_ids, return_inverse=True)
            g_table = np.zeros((len(touched), k))
            np.add.at(g_table, where, np.repeat(per_word, sizes[used], axis=0))
            for x, g, v, at_ in ((table, g_table + 1e-3 * table[touched], speed[0], touched), (start, g_start, speed[1], slice(None)), (trans, g_trans + 1e-2 * trans, speed[2], slice(None))):
                v[at_] += g * g
                x[at_] -= 0.1 * g / np.sqrt(v[at_])
    return model._replace(table=table.astype(np.float32))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """(text, language): of each language the distinct rows of the smallest hashes, as many as its quota."""
    n, out = HELD_OUT
    rows = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).cast("string").alias("_text"))
    rows = rows.where(F.col("_lang").isNotNull() & F.col("_text").rlike("\\p{L}") & ~crc_mod(F.col("_id"), n).isin(*out))
    rows = rows.where(F.length("_text") <= MAX_CHARS)
    # the text is part of the order, so rows without an id are spread like others; level l holds 1 in 2^(l+1) of all rows
    rows = rows.withColumn("_order", F.shiftrightunsigned(F.xxhash64("_id", "_lang", "_text"), 1)).withColumn("_level", 63 - F.length(F.bin("_order")))
    counts = staged(rows.groupBy("_lang", "_level").agg(F.approx_count_distinct("_order").alias("n")), "levels")
    langs = counts.select("_lang").distinct().count()
    if not langs:
        return []
    quota = max(1, min(PER_LANG, SAMPLE_DOCS // langs))
    # the highest level from which on a language has twice its quota; few rows pass, however large the table or the number of its tasks
    above = F.sum("n").over(W.partitionBy("_lang").orderBy(F.desc("_level")))
    cuts = counts.withColumn("_above", above).groupBy("_lang").agg(F.coalesce(F.max(F.when(F.col("_above") >= 2 * quota, F.col("_level"))), F.lit(0)).alias("_cut"))
    near = rows.join(broadcast_if(cuts, langs, MAX_BROADCAST), "_lang").where("_level >= _cut").select("_id", "_lang", "_text", "_order").distinct()
    first = W.partitionBy("_lang").orderBy("_order", "_id", "_text")
    found = near.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= quota).collect()
    found.sort(key=lambda r: (r["_order"], r["_id"] is None, r["_id"], r["_lang"], r["_text"]))
    return [(r["_text"], r["_lang"]) for r in found]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    return train(sample(docs, id_col, text_col, lang_col))


def label_texts(texts: Sequence[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    """(language, score) of each text."""
    lang, score = ["und"] * len(texts), np.zeros(len(texts))
    if not model.langs:
        return lang, score
    held: list[tuple[int, list[str]]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if not held:
            return
        flat = pa.array([w for _, own in held for w in own], pa.string()).dictionary_encode()
        emit = emissions(flat.dictionary.to_pylist(), model.table)[flat.indices.to_numpy()]
        sizes = np.array([len(own) for _, own in held])
        at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        first = np.zeros(len(emit), bool)
        first[at] = True
        mean = np.add.reduceat(posteriors(emit, first, model.start, model.trans), at, axis=0) / sizes[:, None]
        for (i, _), m in zip(held, mean, strict=True):
            best = int(m.argmax())
            lang[i], score[i] = model.langs[best], min(1.0, float(m[best]))
        held.clear()
        size = 0

    for i, text in enumerate(texts):
        own = words_of(text)
        if own:
            held.append((i, own))
            size += len(own)
            if size >= PIECE:
                flush()
    flush()
    return lang, score


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = label_texts(b.column("_text").to_pylist(), model)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    n, out = HELD_OUT
    rows = docs.select(F.col(id_col).alias("doc_id"), crc_mod(F.col(id_col), n).isin(*out).alias("held_out"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
