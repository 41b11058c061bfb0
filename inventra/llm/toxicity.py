"""Toxicity by weak supervision.

1. Lexicon voters: words and stems that mark toxic documents of a labelled sample (log-odds, significance) form LEXICONS lexicons, by the language of the
   documents they occur in (groups of the commonest words around them; no label of a language is read) and by kind, word or stem. Pattern
   voters look at the text without the lexicons: shouting, runs of '!', masked or stretched words, address; and at how often
   and how densely entries occur. A voter that does not fire abstains, which is an outcome of its own; `none` votes for clean.
2. All documents that are not held out vote; the votes of a document are one bit pattern, and the counts of the patterns are the only
   thing that is gathered, of the MOST_PATTERNS commonest of at most 2 ** VOTERS (by far fewer occur).
3. A generative label model, a latent class with a tree of dependences within the class, is fitted to these counts by expectation
   maximisation: it estimates every voter's accuracies and the correlations of dependent voters.
4. Its posterior labels of the sample train a linear classifier on the entries, the votes, and hashed words and word beginnings of the whole text, which
   the voters don't see. It scores every document.

Labels are learned from a bounded sample (PER_CLASS documents of a label, of MAX_CHARS characters at most, whole).
Defined cases: null or empty text scores the classifier's offset, which is low; without both labels every score is 0; repeated
rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, labelled_sample
from .simhash_dedup import fingerprint, shingle_hashes

PER_CLASS = 2500
MAX_CHARS = 20_000
HELD_OUT = (5, (0,))
#: Groups of languages; each has a lexicon of words and one of stems.
GROUPS = 4
LEXICONS = 2 * GROUPS
LEXICON_WORDS = 160
#: Words of address in four languages.
ADDRESS = "you your you're u ya tu toi vous du dich dir sie ihr euch usted ustedes ti te vosotros".split()
PATTERNS = ("several", "dense", "repeated", "addressed", "shouted", "exclaimed", "masked", "stretched", "none")
VOTERS = LEXICONS + len(PATTERNS)
MOST_PATTERNS = 50_000
THRESHOLD = 0.5
_WORD = re.compile(r"\w+")
_ADDRESSED = re.compile(r"(?<!\w)(?:" + "|".join(ADDRESS) + r")(?!\w)")
_SHOUTED = re.compile(r"(?<!\w)[A-ZÀ-ÖØ-Þ]{3,}(?!\w)")
_EXCLAIMED = re.compile(r"!\s*!")
#: A symbol between letters, and a character four times in a row.
_MASKED = re.compile(r"[*@$#](?<=[^\W\d_].)[*@$#]*[^\W\d_]")
_FOURFOLD = re.compile(r"(.)\1\1\1")
_MARKS = ".,;:!?\"'()[]{}…«»“”"
#: Bits of the hashed features, the documents of the sample that a feature must be in, and their penalty.
HASH_BITS = 18
LEAST_DOCS = 5
HASH_PENALTY = 3e-3
BEGINNING = 5
#: Lengths of stems, and the mark that ends a whole word.
STEMS = (4, 5, 6, 7, 8)
END = "$"
#: Bits in which the fingerprints of near copies differ at most.
COPY_BITS = 10
#: Log-likelihood ratio that an entry must add.
LEAST_GAIN = 18.0


class Lexicon(NamedTuple):
    """entry -> rank, the voter of each rank, and a pattern that finds the words that match an entry."""

    ranks: dict[str, int]
    voter: list[int]
    finder: re.Pattern | None


class Model(NamedTuple):
    lexicon: Lexicon
    weights: np.ndarray
    hashed: np.ndarray
    offset: float
    voters: dict


def _entries(word: str) -> list[str]:
    """Lexicon entries that a word may match: itself (marked by its end) and its stems."""
    return [word + END, *(word[:n] for n in STEMS if n < len(word))]


def _copy_groups(texts: Sequence[str]) -> list[int]:
    """Of each text the first that it is a near copy of, by two-word SimHash; for a sample."""
    fps = np.array([fingerprint(shingle_hashes(t.encode(), 2, 42)) for t in texts], np.uint64)
    group = list(range(len(texts)))
    for i in range(1, len(fps)):
        near = np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= COPY_BITS)
        if len(near):
            group[i] = group[int(near[0])]
    return group


def _finder(entries: Sequence[str]) -> re.Pattern | None:
    """Words that are an entry or begin with a stem; common beginnings are tested once."""
    if not entries:
        return None
    tree: dict = {}
    for e in entries:
        node = tree
        for c in e.removesuffix(END):
            node = node.setdefault(c, {})
        node[""] = r"(?!\w)" if e.endswith(END) else r"\w*"

    def render(node: dict) -> str:
        ways = [re.escape(c) + render(x) for c, x in sorted(node.items()) if c]
        own = node.get("")
        if own == r"\w*":
            return own
        ways += [own] if own else []
        return ways[0] if len(ways) == 1 else "(?:" + "|".join(ways) + ")"

    return re.compile(r"(?<!\w)" + render(tree))


def mine_lexicon(sample: Sequence[tuple[int, str, int]], most: int = LEXICON_WORDS) -> dict[str, int]:
    """entry -> rank, of the words and stems that mark the label 1 (log-likelihood ratio and log-odds). Languages coin new words from the
    stem of an abusive one, so a stem is an entry too. Near copies count once, else their rare words would be marks."""
    own = lambda text: {e for w in set(_WORD.findall(text.lower())) if len(w) > 1 for e in _entries(w)}
    toxic, clean = [t for _, t, y in sample if y], [t for _, t, y in sample if not y]
    if not toxic or not clean:
        return {}
    group = _copy_groups(toxic)
    n1, n0 = len(set(group)), len(clean)
    count = Counter(e for g, e in {(g, e) for t, g in zip(toxic, group, strict=True) for e in own(t)})
    holders: dict[str, set[int]] = {e: set() for e, c in count.items() if c >= max(3, 0.005 * n1)}
    del count
    for text, g in zip(toxic, group, strict=True):
        for e in own(text) & holders.keys():
            holders[e].add(g)
    seen = Counter(e for t in clean for e in own(t) & holders.keys())

    def ratio(a: int, b: int) -> float:
        if a < 3 or np.log((a + 0.5) / (n1 - a + 0.5)) - np.log((b + 0.5) / (n0 - b + 0.5)) < 3.0:
            return 0.0
        t = n0 + n1
        table = ((a, n1, a + b), (b, n0, a + b), (n1 - a, n1, t - a - b), (n0 - b, n0, t - a - b))
        return round(2 * sum(o * np.log(o * t / (r * c)) for o, r, c in table if o), 6)

    kept: list[str] = []
    # of equals the longest, which is the most specific
    for _, _, entry in sorted((-ratio(len(h), seen[e]), -len(e), e) for e, h in holders.items()):
        if len(kept) == most or ratio(len(holders[entry]), seen[entry]) < LEAST_GAIN:
            break
        if any(entry.startswith(k) for k in kept):
            continue
        # a stem must add to the words of it that are entries
        rest = holders[entry].difference(*(holders[k] for k in kept if k.startswith(entry)))
        if ratio(len(rest), seen[entry]) >= LEAST_GAIN:
            kept.append(entry)
    return {e: i for i, e in enumerate(kept)}


def group_lexicon(ranks: dict[str, int], sample: Sequence[tuple[int, str, int]]) -> Lexicon:
    """Entries dealt to voters: by the commonest words of the documents that hold them, grouped around the entries that differ most, and by kind."""
    bags = [set(_WORD.findall(t.lower())) for _, t, _ in sample]
    common = [w for w, _ in sorted(Counter(w for b in bags for w in b).items(), key=lambda x: (-x[1], x[0]))[:200]]
    profile = np.zeros((len(ranks), len(common)))
    finder = _finder(list(ranks))
    for (_, text, y), bag in zip(sample, bags, strict=True):
        if y and finder is not None:
            row = np.array([w in bag for w in common], float)
            for r in {_rank(w, ranks) for w in finder.findall(text.lower())} - {None}:
                profile[r] += row
    profile /= np.maximum(1e-9, np.linalg.norm(profile, axis=1, keepdims=True))
    centres: list[int] = []
    for _ in range(min(GROUPS, len(ranks))):
        far = (profile @ profile[centres].T).max(1) if centres else np.zeros(len(ranks))
        if centres and far.min() > 0.8:  # all are alike
            break
        centres.append(int(far.argmin()))
    group = (profile @ profile[centres].T).argmax(1) if centres else np.zeros(0, int)
    return Lexicon(ranks, [2 * int(group[r]) + int(not e.endswith(END)) for e, r in ranks.items()], finder)


def _rank(word: str, ranks: dict[str, int]) -> int | None:
    for e in _entries(word):
        r = ranks.get(e)
        if r is not None:
            return r
    return None


def observe(text: str | None, lexicon: Lexicon) -> tuple[int, list[int]]:
    """(votes as bits, ranks of the lexicon entries found, once each)."""
    if not text:
        return 1 << (LEXICONS + PATTERNS.index("none")), []
    lower = text.lower()
    found = [r for w in (lexicon.finder.findall(lower) if lexicon.finder else ()) if (r := _rank(w, lexicon.ranks)) is not None]
    distinct = sorted(set(found))
    votes = 0
    for r in distinct:
        votes |= 1 << lexicon.voter[r]
    words = max(1, lower.count(" ") + lower.count("\n"))
    flags = [
        len(distinct) >= 2,
        len(found) * 200 >= words and bool(found),
        len(found) > len(distinct),
        len(_ADDRESSED.findall(lower)) * 40 >= words and words >= 4,
        len(_SHOUTED.findall(text)) * 20 >= words and words >= 4,
        bool(_EXCLAIMED.search(text)),
        bool(_MASKED.search(text)),
        any(m[1].isalpha() for m in _FOURFOLD.finditer(lower)),
        not found,
    ]
    for k, flag in enumerate(flags):
        votes |= int(flag) << (LEXICONS + k)
    return votes, distinct


def hashed_words(text: str | None, known: dict[str, tuple[int, ...]]) -> np.ndarray:
    """Buckets of the distinct words of the text, without marks around them, and of their beginnings. known: buckets of words met before."""
    out: set[int] = set()
    for w in set(text.lower().split()) if text else ():
        own = known.get(w)
        if own is None:
            bare = w.strip(_MARKS)
            own = (zlib.crc32(bare.encode()) >> (32 - HASH_BITS), zlib.crc32(bare[:BEGINNING].encode(), 1) >> (32 - HASH_BITS))
            if len(known) < 500_000:
                known[w] = own
        out.update(own)
    return np.fromiter(out, np.int64, len(out))


def vote_counts(docs: DataFrame, lexicon: Lexicon, id_col: str, text_col: str) -> dict[int, int]:
    """pattern of votes -> number of documents that are not held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = Counter(observe(t, lexicon)[0] for t in b.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), pa.array(list(own.values()), pa.int64())], ["votes", "n"])

    n, out = HELD_OUT
    rows = docs.where(~crc_mod(F.col(id_col), n).isin(*out)).select(F.col(text_col).cast("string").alias("_text"))
    counts = rows.mapInArrow(run, "votes int, n long").groupBy("votes").agg(F.sum("n").alias("n"))
    return {r["votes"]: r["n"] for r in counts.orderBy(F.desc("n"), "votes").limit(MOST_PATTERNS).collect()}


def _bits(patterns: np.ndarray) -> np.ndarray:
    return (patterns[:, None] >> np.arange(VOTERS)) & 1


class LabelModel:
    """P(y) and, for each class, P(root vote | y) and P(vote | parent's vote, y) along a tree."""

    def __init__(self, start: np.ndarray, labels: np.ndarray, rounds: int = 60, dependent: float = 0.002):
        v, y = _bits(start), labels
        post = np.where(y == 1, 0.98, 0.02)
        self.parent = [-1] * VOTERS
        self._learn(v, np.ones(len(v)), post)
        self.rounds, self.dependent = rounds, dependent

    def _learn(self, v: np.ndarray, n: np.ndarray, post: np.ndarray) -> None:
        mass = np.stack([n * (1 - post), n * post])
        self.prior = (mass.sum(1) + 1) / (mass.sum() + 2)
        self.table = np.zeros((VOTERS, 2, 2))  # voter, class, parent's vote
        for i, p in enumerate(self.parent):
            for y in (0, 1):
                for u in (0, 1):
                    own = mass[y] * ((v[:, p] == u) if p >= 0 else 1)
                    self.table[i, y, u] = ((own * v[:, i]).sum() + 0.5) / (own.sum() + 1.0)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        v = _bits(patterns)
        log = np.log(self.prior)[:, None].repeat(len(v), 1)
        for i, p in enumerate(self.parent):
            u = v[:, p] if p >= 0 else np.zeros(len(v), int)
            for y in (0, 1):
                q = self.table[i, y][u]
                log[y] += np.log(np.where(v[:, i] == 1, q, 1 - q))
        d = np.clip(log[1] - log[0], -30, 30)
        return 1 / (1 + np.exp(-d))

    def _correlations(self, v: np.ndarray, n: np.ndarray, post: np.ndarray) -> np.ndarray:
        """Mutual information of each pair within the classes, in shares of the class-weighted documents."""
        out = np.zeros((VOTERS, VOTERS))
        for y, m in ((0, n * (1 - post)), (1, n * post)):
            total = m.sum()
            if total <= 0:
                continue
            one = (m[:, None] * v).sum(0) / total
            both = (m[:, None] * v).T @ v / total
            for a, b, pa_, pb in ((1, 1, one, one), (1, 0, one, 1 - one), (0, 1, 1 - one, one), (0, 0, 1 - one, 1 - one)):
                joint = both if (a, b) == (1, 1) else one[:, None] - both if (a, b) == (1, 0) else one[None, :] - both if (a, b) == (0, 1) else 1 - one[:, None] - one[None, :] + both
                with np.errstate(divide="ignore", invalid="ignore"):
                    term = joint * np.log(joint / (pa_[:, None] * pb[None, :]))
                out += self.prior[y] * np.nan_to_num(term, nan=0.0, posinf=0.0, neginf=0.0)
        np.fill_diagonal(out, 0)
        return out

    def fit(self, counts: dict[int, int]) -> LabelModel:
        patterns, n = np.array(list(counts), np.int64), np.array(list(counts.values()), float)
        v = _bits(patterns)
        for part in range(2):  # first without dependences, then along the tree that the residual correlations span
            for _ in range(self.rounds):
                self._learn(v, n, self.posterior(patterns))
            if part == 0:
                mi = self._correlations(v, n, self.posterior(patterns))
                joined, order = list(range(VOTERS)), []
                for w, i, j in sorted(((mi[i, j], i, j) for i in range(VOTERS) for j in range(i)), reverse=True):
                    root = lambda x: x if joined[x] == x else root(joined[x])  # noqa: E731, B023
                    if w > self.dependent and root(i) != root(j):
                        joined[root(i)] = root(j)
                        order.append((i, j))
                self.parent = self._directed(order)
        self.correlations = self._correlations(v, n, self.posterior(patterns))
        return self

    @staticmethod
    def _directed(edges: list[tuple[int, int]]) -> list[int]:
        near: dict[int, list[int]] = {i: [] for i in range(VOTERS)}
        for i, j in edges:
            near[i].append(j)
            near[j].append(i)
        parent, seen = [-1] * VOTERS, set()
        for start in range(VOTERS):
            todo = [start] if start not in seen else []
            seen.add(start)
            while todo:
                x = todo.pop()
                for y in near[x]:
                    if y not in seen:
                        seen.add(y)
                        parent[y] = x
                        todo.append(y)
        return parent


def _features(votes: int, ranks: list[int], n_lexicon: int) -> np.ndarray:
    x = np.zeros(n_lexicon + VOTERS + 1)
    x[ranks] = 1.0
    x[n_lexicon : n_lexicon + VOTERS] = (votes >> np.arange(VOTERS)) & 1
    x[-1] = min(len(ranks), 8) / 4
    return x


def train(sample: Sequence[tuple[int, str, int]], lexicon: Lexicon, counts: dict[int, int]) -> Model:
    """The label model over all votes, and the classifier on its posterior labels of the sample."""
    seen = [observe(t, lexicon) for _, t, _ in sample]
    votes = np.array([s[0] for s in seen], np.int64)
    model = LabelModel(votes, np.array([label for *_, label in sample])).fit(counts)
    soft = model.posterior(votes)
    x = np.stack([_features(*s, len(lexicon.ranks)) for s in seen])
    known: dict[str, tuple[int, ...]] = {}
    buckets = [hashed_words(t, known) for _, t, _ in sample]
    sizes = np.array([len(b) for b in buckets])
    flat = np.concatenate(buckets) if buckets else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(sample)), sizes)
    share = np.repeat(1 / np.sqrt(np.maximum(1, sizes)), sizes)
    common = np.bincount(flat, minlength=1 << HASH_BITS)[flat] >= LEAST_DOCS
    owner, share = owner[common], share[common]
    frequent, flat = np.unique(flat[common], return_inverse=True)
    w, h, b = np.zeros(x.shape[1]), np.zeros(len(frequent)), 0.0
    # each class as a whole weighs the same
    weight = np.where(soft > 0.5, 0.5 / max(1, (soft > 0.5).sum()), 0.5 / max(1, (soft <= 0.5).sum())) * len(x)
    speed, speed_h = np.full(x.shape[1] + 1, 1e-8), np.full(len(frequent), 1e-8)
    for _ in range(400):
        z = x @ w + b + np.bincount(owner, share * h[flat], len(x))
        e = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - soft) / len(x)
        g = np.append(x.T @ e + 1e-4 * w, e.sum())
        speed += g * g
        step = 0.3 * g / np.sqrt(speed)
        w, b = w - step[:-1], b - step[-1]
        g = np.bincount(flat, share * e[owner], len(frequent)) + HASH_PENALTY * h
        speed_h += g * g
        h = h - 0.05 * g / np.sqrt(speed_h)
    hashed = np.zeros(1 << HASH_BITS, np.float32)
    hashed[frequent] = h
    names = [f"{kind}_{i}" for i in range(GROUPS) for kind in ("words", "stems")] + list(PATTERNS)
    voters = {k: {"fires_if_toxic": float(model.table[i, 1].mean()), "fires_if_clean": float(model.table[i, 0].mean()), "depends_on": names[model.parent[i]] if model.parent[i] >= 0 else None} for i, k in enumerate(names)}
    return Model(lexicon, w, hashed, float(b), voters)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    sample = labelled_sample(docs, labels, "toxic", PER_CLASS, MAX_CHARS, HELD_OUT, id_col, text_col)
    lexicon = group_lexicon(mine_lexicon(sample), sample)
    if not lexicon.ranks:
        return Model(lexicon, np.zeros(VOTERS + 1), np.zeros(1 << HASH_BITS, np.float32), -30.0, {})
    return train(sample, lexicon, vote_counts(docs, lexicon, id_col, text_col))


def probability(text: str | None, model: Model, known: dict[str, tuple[int, ...]]) -> float:
    votes, ranks = observe(text, model.lexicon)
    n = len(model.lexicon.ranks)
    z = model.offset + float(model.weights[ranks].sum()) + float(model.weights[-1]) * min(len(ranks), 8) / 4
    for i in range(VOTERS):
        if votes >> i & 1:
            z += float(model.weights[n + i])
    words = hashed_words(text, known)
    if len(words):
        z += float(model.hashed[words].sum()) / len(words) ** 0.5
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for b in batches:
            s = np.array([probability(t, model, known) for t in b.column("_text").to_pylist()], float)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    n, out = HELD_OUT
    rows = docs.select(F.col(id_col).alias("doc_id"), crc_mod(F.col(id_col), n).isin(*out).alias("held_out"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
