"""The corpus operators against brute force, round trips and held-out rows, and on awkward tables."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow.dataset as ds
import pytest
import xxhash
from conftest import DATA, frame_of
from pyspark.sql import functions as F

from inventra.llm import decontaminate, html_extract, langid, line_dedup, mixing, quality_compress, quality_rules, queries, quotation, simhash_dedup, toxicity
from inventra.llm.common import staged

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TABLES = "documents pages benchmark labels conversations".split()
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty, white and long texts, repeated rows, ties, and names that operators use inside."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [
        (1, None, None, None, None), (None, "a text without an id", "en", "s", 1), (2, "", "en", "s", 0), (3, " \n\t\n ", None, "s", 5), (4, long, "en", None, len(long)),
        (5, "same words here\nand a line", "en", "s", 1), (5, "same words here\nand a line", "en", "s", 1), (6, "same words here\nand a line", "de", "t", 1), (7, "é ß 漢字   x", "fr", "", 9), (None, None, None, None, None),
    ]
    df = spark.createDataFrame([(*r, "x", 1, "k", 0) for r in rows], SCHEMA + ", id string, part int, _row string, size int")
    return df.withColumn("_id", F.lit(1)).withColumn("_text", F.lit("t")).withColumn("tk", F.lit(3))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.register(t, ds.dataset(f"{DATA}/{t}.parquet").to_table())
    assert frame_of(queries.QUERIES[name](spark, sf_dir)) == frame_of(con.execute(queries.ORACLES[name]).fetchdf())


# mixing


def test_mix_targets_and_caps(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 7 + 1), "en", f"s{i % 4}" if i % 4 else "s0", 1) for i in range(400)], SCHEMA)
    plan = mixing.plan(docs, weights=(100.0, 1.0), cap=3.0).collect()
    taken, target, size = collections.Counter(), {}, {}
    for r in plan:
        taken[r["_source"]] += r.taken
        target[r["_source"]], size[r["_source"]] = r.target, r.source_size
        assert r.taken <= 3 * r.size and r.taken % max(1, r.size) == 0
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    for s in target:
        assert target[s] <= 3 * size[s] + 1e-9 and abs(taken[s] - target[s]) <= 7
    # sources below their cap share by weight
    free = {s: target[s] for s in target if target[s] < 3 * size[s]}
    assert free["s1"] == pytest.approx(free["s3"])


def test_mix_awkward(awkward, empty):
    plan = mixing.plan(awkward).collect()
    assert len(plan) == 10 and {r.taken for r in plan if not r.size} == {0}
    assert sorted(map(tuple, plan), key=str) == sorted(map(tuple, mixing.plan(awkward).collect()), key=str)
    mixed = mixing.mix(awkward)
    assert mixed.columns == awkward.columns
    want = collections.Counter()
    for r in plan:
        want[r["_id"], r["_key"]] += r.copies
    got = collections.Counter((r.doc_id, r.k) for r in mixed.select("doc_id", F.xxhash64("text").alias("k")).collect())
    assert got == collections.Counter({k: n for k, n in want.items() if n})
    assert mixing.mix(empty).count() == 0 == mixing.plan(empty).count()


# quality rules


def brute_rules(text):
    text = text or ""
    w = WORDS.findall(text)
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_rules_awkward(spark, awkward, empty):
    extra = spark.createDataFrame([(20, "a b c d e f g h " * 3, "", "", 0), (21, "x " * 9, "", "", 0), (22, "x " * 8, "", "", 0), (23, "l\nl\n\n \nl", "", "", 0)], SCHEMA)
    for df in (awkward, extra):
        for r in df.select("doc_id", "text").join(quality_rules.judge(df), "doc_id").collect():
            if r.doc_id != 5:
                assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_rules(r.text)
                assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)
    assert quality_rules.judge(awkward).count() == 10 and quality_rules.judge(empty).count() == 0


def test_rules_have_no_user_functions_and_keep_good_texts(spark, sf_dir, documents):
    judged = quality_rules.judge(documents)
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    r = judged.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("n_words >= 20").groupBy("quality", "kept").count().collect()
    n = {(x.quality, x.kept): x["count"] for x in r}
    assert n.get((1, False), 0) <= 0.03 * n[1, True] and n.get((0, True), 0) <= 0.2 * max(1, n.get((0, False), 0))


# line dedup


def brute_lines(docs, least, keep):
    """docs: distinct (id, text) pairs."""
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    where = collections.defaultdict(list)
    for i, t in docs:
        for n, x in enumerate((t or "").split("\n")):
            if key(x):
                where[key(x)].append((i, t, n))
    out = {}
    for i, t in docs:
        kept = []
        for n, x in enumerate((t or "").split("\n")):
            own = where.get(key(x), [])
            hot = len({(a, b) for a, b, _ in own}) >= least
            if not hot or keep == "first" and (i, t, n) == own[0]:
                kept.append(x)
        out[i, t] = "\n".join(kept)
    return out


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("parts", [1, 7, 40])
def test_lines_over_any_number_of_partitions(spark, keep, parts):
    rng = random.Random(2)
    docs = [(i, "\n".join(rng.choice(["Common line ", "  common LINE", "rare", f"own {i}", f"some {rng.randrange(9)}", ""]) for _ in range(rng.randrange(6)))) for i in range(150)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], SCHEMA).repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for least in (2, 10):
            want = brute_lines(docs, least, keep)
            for r in line_dedup.clean(df, least, keep).collect():
                assert r.text == want[r.doc_id, dict(docs)[r.doc_id]]
            for r in line_dedup.digests(df, least, keep).collect():
                kept = want[r.doc_id, dict(docs)[r.doc_id]]
                assert r.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_lines_awkward(awkward, empty):
    cleaned = line_dedup.clean(awkward, 2)
    assert cleaned.columns == awkward.columns and cleaned.count() == 10
    got = {(r.doc_id, r.text) for r in cleaned.collect()}
    assert (1, None) in got and (2, "") in got and (5, "") in got and (6, "") in got and (3, " \n\t\n ") in got
    assert {r.doc_id: r.n_lines for r in line_dedup.digests(awkward).where("doc_id in (1, 2, 3)").collect()} == {1: 1, 2: 1, 3: 3}
    assert line_dedup.digests(empty).count() == 0 and line_dedup.clean(empty).count() == 0


def test_bitmaps_round_trip():
    import pyarrow as pa

    for drops in ([0], [7], [8], [3, 4, 20], list(range(100))):
        raw = line_dedup._bitmap(pa.array([drops], pa.list_(pa.int64())))[0].as_py()
        lines, n = line_dedup.kept_lines("\n".join(map(str, range(120))).encode(), raw)
        assert n == 120 and [int(x) for x in lines] == [i for i in range(120) if i not in drops]


# simhash


def brute_fingerprint(text, size=4):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + size]), 42) for i in range(max(1, len(w) - size + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius=4):
    ids, f = list(fps), np.array(list(fps.values()), np.uint64)
    name = {}
    for i in ids:
        if i in name:
            continue
        seen, todo = {i}, [i]
        while todo:
            x = np.uint64(fps[todo.pop()])
            for j in np.flatnonzero(np.bitwise_count(f ^ x) <= radius):
                if ids[j] not in seen:
                    seen.add(ids[j])
                    todo.append(ids[j])
        for j in seen:
            name[j] = min(seen)
    return name


def test_simhash_query(spark, sf_dir, texts):
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    want = brute_components(fps)
    got = queries.QUERIES["op4_simhash"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (int(r.fingerprint, 16), r.component_id) == (fps[r.doc_id], want[r.doc_id])


@pytest.mark.parametrize("rounds", [1, 4])
def test_links_connect_all_within_the_radius(spark, monkeypatch, rounds):
    monkeypatch.setattr(simhash_dedup, "SMALL_POINTS", 0)
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = {x ^ sum(1 << b for b in rng.sample(range(64), k)) for x in base for k in range(7) for _ in range(3)} | {0, 2**64 - 1, 15}
    df = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp long")
    edges = simhash_dedup.links(df, len(fps), 4, rounds).collect()
    assert all(((e.a ^ e.b) & (2**64 - 1)).bit_count() <= 4 for e in edges)
    got = {r.node % 2**64: r.root % 2**64 for r in simhash_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = collections.defaultdict(set)
    for x, root in brute_components({x: x for x in fps}).items():
        want[root].add(x)
    mine = collections.defaultdict(set)
    for x in fps:
        mine[got.get(x, x)].add(x)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, mine.values()))


def test_simhash_awkward(awkward, empty):
    got = simhash_dedup.classes(awkward).collect()
    assert len(got) == 10
    zero = {r.id for r in got if r.fp == 0}
    assert zero == {1, 2, 3, None} and {r.component_id for r in got if r.fp == 0} == {1}
    assert {r.component_id for r in got if r.id in (5, 6)} == {5}
    kept = simhash_dedup.dedup(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 4, 5, 7] and kept.where("doc_id is null").count() == 2
    assert simhash_dedup.classes(empty).count() == 0 and simhash_dedup.dedup(empty).count() == 0


def near_copies(n=150):
    """Texts, each with a copy of some edited words."""
    rng = random.Random(12)
    v = [f"w{i}" for i in range(3000)]
    out = []
    for _ in range(n):
        w = [rng.choice(v) for _ in range(rng.randrange(120, 260))]
        out.append(" ".join(w))
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(len(w))] = rng.choice(v)
        out.append(" ".join(w))
    return out


def test_dedup_finds_near_copies_of_a_brute_force_join(spark):
    texts = near_copies()
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    pairs = [(a, b) for b in range(len(texts)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    kept = {r.doc_id for r in simhash_dedup.dedup(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)).collect()}
    assert len(pairs) > 100 and all(b == a + 1 and a in kept for a, b in pairs)
    assert sum(b not in kept for _, b in pairs) >= 0.95 * len(pairs)


def test_dedup_of_the_documents_by_five_word_similarity(spark):
    """Distinct texts of sf0.1 with the similarity 0.8 or more by brute force are in one group, and every group hangs together by pairs of 0.5 or more."""
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = {}
    for r in rows.orderBy("doc_id").collect():
        texts.setdefault(r.text, r.doc_id)
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for t, d in texts.items() if (w := (t or "").lower().split())}
    holders = collections.defaultdict(list)
    for d, own in sets.items():
        for x in own:
            holders[x].append(d)
    shared = collections.Counter((a, b) for own in holders.values() if len(own) < 200 for i, b in enumerate(own) for a in own[:i])
    sim = {(min(p), max(p)): n / (len(sets[p[0]]) + len(sets[p[1]]) - n) for p, n in shared.items()}
    kept = {r.doc_id for r in simhash_dedup.dedup(rows.groupBy("text").agg(F.min("doc_id").alias("doc_id"))).select("doc_id").collect()}
    pairs = [p for p, j in sim.items() if j >= 0.8]
    gone = set(sets) - kept
    assert pairs and sum(b in gone or a in gone for a, b in pairs) >= 0.9 * len(pairs)
    assert all(any(sim.get((min(d, e), max(d, e)), 0) >= 0.5 for e in sets if e != d) for d in gone)


@pytest.mark.parametrize("small", [0, 10**9])
def test_dedup_links_all_within_the_radius_in_any_view(spark, monkeypatch, small):
    monkeypatch.setattr(simhash_dedup, "SMALL_POINTS", small)
    monkeypatch.setattr(simhash_dedup, "KEY_BLOCK", 64)
    texts = near_copies(60) + [f"{t} tail{i}" for i, t in enumerate([near_copies(1)[0]] * 80)]
    fps = [[simhash_dedup.fingerprint(simhash_dedup._remixed(simhash_dedup.shingle_hashes(t.encode(), 2, 42), v)) for v in range(6)] for t in texts]
    root = list(range(len(texts)))
    for _ in range(len(texts)):
        new = [min(root[j] for j in range(len(texts)) if any((x ^ y).bit_count() <= 4 for x, y in zip(fps[i], fps[j], strict=True)) and sum((x ^ y).bit_count() for x, y in zip(fps[i], fps[j], strict=True)) <= 53) for i in range(len(texts))]
        if new == root:
            break
        root = new
    got = simhash_dedup.dedup(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)).collect()
    assert {r.doc_id for r in got} == set(root)


# decontamination


def brute_leaks(docs, items, least=0.8):
    shingles = lambda w: collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    out = {}
    for d, t in docs:
        w = WORDS.findall((t or "").lower())
        for i, it in items:
            v = WORDS.findall((it or "").lower())
            if not v or not w or len(v) >= 5 and not set(shingles(v)) & set(shingles(w)):
                continue
            s = shingles(v)
            best = 0.0
            for a in range(max(1, len(w) - len(v) + 1)):
                x = shingles(w[a : a + len(v)])
                best = max(best, sum((s & x).values()) / sum((s | x).values()))
            if best >= least:
                out[d, i] = best
    return out


def test_leaks(spark, documents, sf_dir, texts):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = brute_leaks(list(texts.items()), [tuple(r) for r in bench.collect()])
    got = {(r.id, r.item): r.similarity for r in decontaminate.contaminated(documents, bench).collect()}
    assert got == pytest.approx(want) and got
    assert {r.doc_id for r in decontaminate.clean(documents, bench).collect()} == set(texts) - {d for d, _ in got}


def test_leaks_edited_short_and_repeated_items(spark, awkward, empty):
    rng = random.Random(6)
    v = [f"v{i}" for i in range(300)]
    item = [rng.choice(v) for _ in range(50)]
    fill = lambda n: [rng.choice(v) for _ in range(n)]
    docs = {
        1: fill(100) + item + fill(100), 2: item, 3: item[:25] + ["edit"] + item[25:], 4: fill(10) + item[1:] + fill(10), 5: item[:48], 6: ["Two", "words"], 7: fill(50) + ["two", "WORDS"],
        8: ["r"] * 40, 9: fill(300), 10: item[:20], 11: ["a", "b"] * 30,
    }
    items = {1: " ".join(item), 2: "two words", 3: " ".join(["r"] * 20), 4: "", 5: None, 6: " ".join(["a", "b"] * 10), 7: " ".join(item), 8: "solo"}
    rows = [(i, " ".join(w), "en", "s", 0) for i, w in docs.items()]
    df, bench = spark.createDataFrame(rows + rows[:2], SCHEMA), spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = brute_leaks([r[:2] for r in rows], list(items.items()))
    assert {(r.id, r.item): r.similarity for r in decontaminate.contaminated(df, bench).collect()} == pytest.approx(want)
    assert decontaminate.contaminated(awkward, bench).count() == 0 and decontaminate.clean(awkward, bench).count() == 10
    assert decontaminate.clean(empty, bench).count() == 0 and decontaminate.clean(df, bench.where("false")).count() == len(rows) + 2


def test_leaks_of_documents_shorter_than_the_item(spark):
    rng = random.Random(7)
    v = [f"v{i}" for i in range(300)]
    items = {n: [rng.choice(v) for _ in range(n)] for n in (3, 5, 9, 15, 45, 120)}
    items[200] = ["r", "s"] * 20
    docs = [w[a : a + n] for w in items.values() for n in range(int(0.75 * len(w)), len(w) + 1) for a in (0, (len(w) - n) // 2, len(w) - n)]
    rows = [(i, " ".join(w), "en", "s", 0) for i, w in enumerate(docs)]
    bench = [(i, " ".join(w)) for i, w in items.items()]
    want = brute_leaks([r[:2] for r in rows], bench)
    got = decontaminate.contaminated(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {(r.id, r.item): r.similarity for r in got} == pytest.approx(want)
    assert any(len(docs[d]) == 40 and i == 45 for d, i in want)


def test_leaks_at_the_least_similarity(spark):
    """Edited items of all lengths inside long texts, against all windows: the radius may miss a few at 0.8, nothing else is added."""
    rng = random.Random(21)
    v = [f"v{i}" for i in range(4000)]
    items = [[rng.choice(v) for _ in range(n)] for n in range(12, 72)]
    items += [[rng.choice(v) for _ in range(300)]]
    docs = []
    for w in items:
        for edits in (0, 1, 2, 3):
            x = list(w)
            for _ in range(edits):
                x[rng.choice((0, 1, -1, -2, rng.randrange(len(x))))] = "edit"
            docs.append([rng.choice(v) for _ in range(rng.randrange(300))] + x + [rng.choice(v) for _ in range(rng.randrange(300))])
    rows = [(i, " ".join(w), "en", "s", 0) for i, w in enumerate(docs)]
    bench = [(i, " ".join(w)) for i, w in enumerate(items)]
    want = brute_leaks([r[:2] for r in rows], bench)
    got = {(r.id, r.item): r.similarity for r in decontaminate.contaminated(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert set(got) <= set(want) and all(got[k] == pytest.approx(want[k]) for k in got)
    low = [k for k in want if want[k] < 0.86]
    assert len(low) > 15 and sum(k in got for k in low) >= 0.9 * len(low) and sum(k in got for k in want) >= 0.98 * len(want)


def test_index_holds_all_within_the_radius(spark):
    """Fingerprints at up to RADIUS bits from an item's share a key with it."""
    rng = random.Random(3)
    fps = [rng.getrandbits(63) for _ in range(20)]
    items = spark.createDataFrame([(i, 7, f) for i, f in enumerate(fps)], "item long, size int, fp long")
    keys = collections.defaultdict(set)
    for r in decontaminate.index_rows(items, decontaminate.RADIUS).collect():
        keys[r.item].add(r.key)
    cuts = decontaminate._block_cuts()
    for i, f in enumerate(fps):
        for _ in range(200):
            x = f ^ sum(1 << b for b in rng.sample(range(63), decontaminate.RADIUS))
            assert any((x >> a & (1 << z - a) - 1) + (k << decontaminate.BLOCK_BITS) in keys[i] for k, (a, z) in enumerate(cuts))


def test_leaks_run_no_python(documents, spark, sf_dir):
    plan = decontaminate.contaminated(documents, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


# classifiers


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


def corpus(spark, n=600):
    rng = random.Random(8)
    words = {"en": "the of and that with from house green river stone walk under".split(), "fr": "le la des une pour dans maison verte rivière pierre marche sous".split(), "de": "der die und das nicht haus grün fluss stein unter über zwischen".split()}
    docs, labels = [], []
    for i in range(n):
        lang = rng.choice(list(words))
        w = [rng.choice(words[lang]) + rng.choice(["", "s", "e", "en"]) for _ in range(rng.randrange(20, 80))]
        good, toxic = rng.random() < 0.7, rng.random() < 0.3
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(["zork", "blarg", "frell", "smeg", "gorram", "dren"]))
        if not good:
            w = [x + rng.choice(["$$$", "###", "%%%"]) for x in w]
        docs.append((i, " ".join(w), lang, "s", 0))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def learned(spark):
    return corpus(spark)


def test_toxicity_on_held_out_rows(spark, learned, awkward, empty):
    docs, labels = learned
    model = toxicity.fit(docs, labels)
    assert all(toxicity._rank(w, model.lexicon.ranks) is not None for w in ("zork", "blarg", "frell", "smeg", "gorram", "dren"))
    got = toxicity.score(docs, model).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert held and {r.doc_id for r in held} == {r.doc_id for r in got if crc(r.doc_id, 5) == 0}
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert {r.predicted for r in toxicity.score(awkward, model).collect()} == {0} and toxicity.score(awkward, model).count() == 10
    none = toxicity.fit(docs, labels.where("false"))
    assert {r.predicted for r in toxicity.score(docs, none).collect()} == {0} and toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0


def test_toxicity_learns_nothing_from_held_out_labels(learned):
    docs, labels = learned
    flipped = labels.withColumn("toxic", F.expr("if(crc32(cast(doc_id as string)) % 5 = 0, 1 - toxic, toxic)"))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert a.lexicon.ranks == b.lexicon.ranks and a.lexicon.voter == b.lexicon.voter and np.allclose(a.weights, b.weights) and np.allclose(a.hashed, b.hashed)


def test_label_model_finds_accuracies_and_correlation():
    rng = np.random.default_rng(0)
    n = 40_000
    y = rng.random(n) < 0.2
    v = np.zeros((n, toxicity.VOTERS), int)
    for i in range(8):
        v[:, i] = rng.random(n) < np.where(y, 0.5, 0.03)
    v[:, 9] = np.where(rng.random(n) < 0.9, v[:, 0], v[:, 9])  # a copy of voter 0
    bits = (v << np.arange(toxicity.VOTERS)).sum(1)
    model = toxicity.LabelModel(bits[:2000], y[:2000].astype(int)).fit(dict(collections.Counter(bits.tolist())))
    assert np.allclose(model.table[1:8, 1].mean(1), 0.5, atol=0.05) and np.allclose(model.table[1:8, 0].mean(1), 0.03, atol=0.02)
    assert 9 == model.parent[0] or 0 == model.parent[9]
    assert np.mean((model.posterior(bits) > 0.5) == y) > 0.97


def test_label_model_posterior_by_enumeration():
    """The posterior of every vote pattern of six voters that fire at random is that of the model's own probabilities, which sum to 1."""
    rng = np.random.default_rng(2)
    bits = rng.integers(0, 64, 4000)
    model = toxicity.LabelModel(bits, rng.integers(0, 2, 4000), rounds=5, dependent=0.0).fit(dict(collections.Counter(bits.tolist())))
    joint = np.zeros((64, 2))
    for p in range(64):
        for y in (0, 1):
            q = model.prior[y]
            for i in range(toxicity.VOTERS):
                parent = model.parent[i]
                one = model.table[i, y, p >> parent & 1 if parent >= 0 else 0]
                q *= one if p >> i & 1 else 1 - one
            joint[p, y] = q
    assert np.allclose(model.posterior(np.arange(64)), joint[:, 1] / joint.sum(1), atol=1e-9)


def test_finder_finds_words_and_stems():
    entries = ["smeg$", "smeg", "idio", "dolt$", "a.b$"]
    found = toxicity._finder(entries).findall("Smeg smegma idiots dolts dolt xsmeg a.b axb".lower())
    assert found == ["smeg", "smegma", "idiots", "dolt", "a.b"] and toxicity._finder([]) is None


def test_quality_on_held_out_rows(spark, learned, awkward, empty):
    docs, labels = learned
    model = quality_compress.fit(docs, labels)
    got = quality_compress.score(docs, model).join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in got if r.held_out]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert quality_compress.score(awkward, model).count() == 10 and quality_compress.score(empty, model).count() == 0
    kept = quality_compress.keep(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted}
    alone = quality_compress.score(docs, quality_compress.fit(docs, labels.where("quality = 1")))
    assert {r.predicted for r in alone.collect()} == {1}


def test_calibration_is_monotone():
    rng = np.random.default_rng(3)
    x = rng.normal(size=3000)
    y = (rng.random(3000) < 1 / (1 + np.exp(-3 * x))).astype(float)
    knots, values = quality_compress._curve(x, y, np.ones(3000))
    assert np.all(np.diff(knots) > 0) and np.all(np.diff(values) >= 0)
    assert abs(np.interp(0.0, knots, values) - 0.5) < 0.1


def test_language_on_held_out_rows(spark, learned, awkward, empty):
    docs, _ = learned
    model = langid.fit(docs)
    got = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in got if r.held_out]) > 0.98
    odd = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(awkward, model).where("doc_id is not null").collect()}
    assert odd[1] == odd[2] == odd[3] == ("und", 0.0) and odd[7][0] in model.langs
    assert langid.predict(empty, langid.fit(empty)).count() == 0
    assert np.all(np.diag(model.trans) > model.trans.mean(1))


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    start, trans = rng.normal(size=3), rng.normal(size=(3, 3))
    for cuts in ([0], [0, 1, 2, 3], [0, 10, 33, 34], list(range(50))):
        e = rng.normal(size=(57, 3)).astype(np.float32) * 2
        first = np.zeros(57, bool)
        first[cuts] = True
        got = langid.posteriors(e, first, start, trans)
        for a, z in zip(cuts, [*cuts[1:], 57], strict=True):
            x = np.exp(e[a:z].astype(float))
            f, b = [np.exp(start) * x[0]], [np.ones(3)]
            for i in range(1, z - a):
                f.append((f[-1] @ np.exp(trans)) * x[i])
            for i in range(z - a - 1, 0, -1):
                b.insert(0, np.exp(trans) @ (x[i] * b[0]))
            want = np.array(f) * np.array(b)
            assert np.allclose(got[a:z], want / want.sum(1, keepdims=True), atol=1e-6)


def test_posteriors_are_those_of_all_labelings():
    """A chain of four words and three languages, by enumeration of its 81 labelings."""
    import itertools

    rng = np.random.default_rng(5)
    e, start, trans = rng.normal(size=(4, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    want, total = np.zeros((4, 3)), 0.0
    for y in itertools.product(range(3), repeat=4):
        w = np.exp(start[y[0]] + sum(e[i, y[i]] for i in range(4)) + sum(trans[a, b] for a, b in itertools.pairwise(y)))
        total += w
        for i in range(4):
            want[i, y[i]] += w
    got = langid.posteriors(e.astype(np.float32), np.array([True, False, False, False]), start, trans)
    assert np.allclose(got, want / total, atol=1e-6)


def test_language_sample_has_the_smallest_hashes(spark, monkeypatch):
    monkeypatch.setattr(langid, "PER_LANG", 50)
    rows = [(i, f"text {i}", "en") for i in range(6000)] + [(None, f"none {i}", "de") for i in range(3000)] + [(7, "again and again", "fr")] * 5000 + [(i, f"mot {i}", "fr") for i in range(90_000, 90_030)]
    rows += [(1, "1 2 3", "xx"), (2, None, "yy"), (3, "text", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    got = langid.sample(df)
    seen = {lang: [t for t, own in got if own == lang] for lang in ("en", "de", "fr")}
    assert len(got) == sum(map(len, seen.values())) and len(set(got)) == len(got)
    fit = {r["doc_id"] for r in df.where(~langid.crc_mod(langid.F.col("doc_id"), 3).isin(1)).select("doc_id").distinct().collect()}
    assert len(seen["en"]) == len(seen["de"]) == 50
    assert set(seen["fr"]) == {t for i, t, lang in rows if lang == "fr" and i in fit}
    hashed = df.where("lang = 'de'").distinct().orderBy(langid.F.shiftrightunsigned(langid.F.xxhash64("doc_id", "lang", "text"), 1)).limit(50).collect()
    assert {r["text"] for r in hashed} == set(seen["de"])


def test_language_learns_every_language_in_few_scans(spark):
    """66 languages, one of them with most rows; every one can be predicted, and digits or fractions alone are no text."""
    rng = random.Random(4)
    docs = []
    for i in range(1320):
        k = i % 66 if i < 660 else 0
        a = chr(97 + k % 26) + chr(97 + k // 26 * 5) + chr(97 + k % 26)
        docs.append((i, " ".join(a + rng.choice("xyzwvu") + a for _ in range(20)), f"l{k}", "s", 0))
    df = spark.createDataFrame([*docs, (5000, "½ ² ١٢ 3_4", "l1", "s", 0)], SCHEMA)
    model = langid.fit(df)
    assert len(model.langs) == 66
    got = langid.predict(df, model).collect()
    lang = {r[0]: r[2] for r in docs}
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got if r.doc_id < 660]) > 0.9
    assert [(r.lang_pred, r.score) for r in got if r.doc_id == 5000] == [("und", 0.0)]


def test_code_switched_words_are_told_apart(learned):
    docs, _ = learned
    model = langid.fit(docs)
    words = langid.words_of("the green river under stone walk des maison verte rivière pour dans")
    post = langid.posteriors(langid.emissions(words, model.table), np.arange(len(words)) == 0, model.start, model.trans)
    assert [model.langs[i] for i in post.argmax(1)] == ["en"] * 6 + ["fr"] * 6


# html


PAGES = [
    ("<html><body><header><h1>Site</h1></header><nav><a href=x>a</a></nav><div id='cookie-notice'>We use cookies.</div><div class=content><h2>Title</h2><p>A long paragraph, with commas, and text. It goes on, and on.<p>Short.</p><ul><li>one item<li>two</ul></div>"
     "<aside>Side text, with punctuation, and more text here.</aside><section class='comments'><p>Nice article, I liked it. Thanks, friend.</p></section><form>Search <input></form><footer>(c)</footer></body></html>",
     "Title\nA long paragraph, with commas, and text. It goes on, and on.\nShort.\none item\ntwo"),
    ("<article><p>One &amp; two &lt;3&gt; &eacute;&#233;&#xe9;  spaced\n\tout</p><script>var a='</p><p>no';</script><!-- <p>no</p> --><p>Last <b>bold <i>words</b></i>.</article>", "One & two <3> ééé spaced out\nLast bold words."),
    ("plain text", "plain text"), ("", ""), (None, ""), ("<p>unclosed <!-- comment", "unclosed"), ("a < b and c > d", "a < b and c > d"), ("<nav><p>only a menu</p></nav>", ""),
]


def test_html(spark):
    df = spark.createDataFrame([(i, f"u{i}", h) for i, (h, _) in enumerate(PAGES)] + [(0, "u0", PAGES[0][0])], "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("_html", F.lit("x"))
    got = html_extract.extract(df).collect()
    assert len(got) == len(PAGES) + 1
    for r in got:
        assert r.text == PAGES[r.page_id][1] and r.n_chars == len(r.text)
    assert html_extract.extract(df.where("false")).count() == 0


def test_html_of_all_pages(spark, sf_dir):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in queries.QUERIES["op9_html"](spark, sf_dir).collect():
        body = pages[r.page_id].partition("<article>")[2].partition("</article>")[0]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"<p>|</p>|</h1>|<br>", body)]
        assert r.text == "\n".join(x for x in parts if x)


def test_html_paths_choose_the_node_without_names():
    """Neutral tags and classes: the ratios of the paths alone find the article."""
    para = "<div class=x{}><div>{} is told here at some length, with commas, with stops. It goes on, and on, until it ends.</div><div>Then {}, as was said, comes in, and more follows. That is all.</div></div>"
    menu = "<div class=x1>" + "".join(f"<div><a href=/{i}>Entry {i}</a></div>" for i in range(12)) + "</div>"
    side = "<div class=x3><div><span>Latest</span></div><div>Number 1</div><div>Number 2</div></div>"
    page = f"<html><body>{menu}{side}<div class=x2><div><section>{para.format(5, 'A tale', 'a hero')}{para.format(5, 'A song', 'a bird')}</section></div></div>{menu}<div>(c) us</div></body></html>"
    want = [x for t, h in (("A tale", "a hero"), ("A song", "a bird")) for x in (f"{t} is told here at some length, with commas, with stops. It goes on, and on, until it ends.", f"Then {h}, as was said, comes in, and more follows. That is all.")]
    assert html_extract.main_text(page, names=False).split("\n") == want
    # links, lists, short lines and uneven sections inside an article stay whole
    inner = "<h1>Head</h1><p>Intro, short.</p><section><p>" + "Long text, with marks, and more. " * 40 + "</p></section><p><a href=/r>Read the full report</a></p><ul><li><a href=/1>one</a></li></ul>"
    got = html_extract.main_text(f"<body>{menu}<article>{inner}</article>{side}</body>", names=False).split("\n")
    assert got[:2] == ["Head", "Intro, short."] and got[3:] == ["Read the full report", "one"] and len(got) == 5


def test_html_names_decide_nothing_on_nearly_all_pages(spark, sf_dir):
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    same = sum(html_extract.main_text(h) == html_extract.main_text(h, names=False) for h in pages)
    assert same >= 0.9 * len(pages)


def test_html_deep_and_long_pages_take_linear_time():
    import time

    for page in ("<div>a" * 40_000, "<p><button>" + "<div><i>a</b>" * 20_000, "<ul><li>" * 20_000, "<b>" * 30_000 + "x", "<table><tr><td>" * 10_000, "<p>Some text, and more.</p>" * 60_000):
        began = time.perf_counter()
        html_extract.main_text(page)
        assert time.perf_counter() - began < 10
    assert html_extract.main_text("<table><tr><td>One, two.<td>Three, four.<tr><td><p>Five, six.<td>Seven.</table>") == "One, two.\nThree, four.\nFive, six.\nSeven."


# quotation


def test_quotations(spark):
    first = "Shall we meet on Monday at the station?\nI would bring the maps along."
    rows = [
        (1, 0, "user", first), (1, 1, "assistant", "> Shall we meet on Monday at\n> the station?\nYes, at nine o'clock then."), (1, 2, "user", "Alice wrote:\n> Yes, at nine o'clock then.\n>> Shall we meet on Monday at the station?\nGood, see you there."),
        (1, 3, "user", "> never said by anyone here\nHm."), (1, 4, "user", "> I would bring the maps along.\nPlease do."), (2, 0, "user", first), (2, 1, "user", None), (2, 2, "user", ""), (None, 0, "x", "> quoted"), (3, None, "x", "text"), (1, 4, "user", "> I would bring the maps along.\nPlease do."),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, key int")
    got = collections.defaultdict(list)
    for r in quotation.conversations(df).collect():
        got[r.conv_id, r.turn].append(r)
    assert sum(map(len, got.values())) == len(rows)
    one = {t: got[1, t][0] for t in range(5)}
    assert one[1].reply_to == 0 and one[1].text == "Yes, at nine o'clock then." and one[1].n_quoted == 1
    assert one[2].reply_to == 1 and one[2].text == "Good, see you there." and (one[2].n_levels, one[2].n_quoted, one[2].n_linked) == (2, 2, 2)
    assert (one[2].thread_turn, one[2].depth) == (0, 2)
    assert one[3].reply_to is None and one[3].text == "Hm." and one[4].reply_to == 0
    order = sorted((r.position, t) for (c, t), own in got.items() for r in own if c == 1)
    assert [t for _, t in order] == [0, 1, 2, 4, 4, 3] and [p for p, _ in order] == list(range(6))
    assert got[2, 1][0].text == "" and got[2, 0][0].reply_to is None
    assert quotation.conversations(df.where("false")).count() == 0


def brute_links(rows):
    """(conv, turn) -> (reply_to, n_linked) of threads without nested runs: rows are (conv, turn, role, text)."""
    normal = lambda x: re.sub(r"[\W_]+", " ", x.lower()).strip()
    units = lambda x: {u for u in map(normal, [x, *re.split(r"\n[ \t]*\n", x), *x.split("\n")]) if u}
    own, out = collections.defaultdict(list), {}
    for conv, turn, _, text in sorted(rows):
        runs = []
        for line in text.split("\n"):
            level = len(re.match(r"(?:[ \t]*>)*", line)[0].replace(" ", "").replace("\t", ""))
            line = re.sub(r"^(?:[ \t]*>)+[ ]?", "", line)
            if not runs or runs[-1][0] != level:
                runs.append((level, []))
            runs[-1][1].append(line)
        best, linked = None, 0
        for level, lines in runs:
            hits = [(-level, len(u), t) for u in units("\n".join(lines)) for t, us in own[conv] if level and t < turn and u in us]
            linked += bool(hits)
            best = max([*hits, *([best] if best else [])], default=None)
        own[conv].append((turn, units("\n".join(x for level, lines in runs if not level for x in lines).strip("\n"))))
        out[conv, turn] = (best[2] if best else None, linked)
    return out


@pytest.mark.parametrize("parts", [1, 9])
def test_quotations_of_the_conversations(spark, sf_dir, parts):
    """Threads made of the conversations' own messages: quotes of whole messages, of lines, of short lines and of repeated ones, against brute force."""
    rng = random.Random(9)
    rows = []
    own = collections.defaultdict(list)
    for r in sorted(map(tuple, spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect())):
        conv, turn, role, text = r[0] % 7, r[0] * 100 + r[1], r[2], re.sub(r"^[ \t]*>+", "", r[3] or "", flags=re.M)
        text = rng.choice([text, "ok", text + "\nok", "Short line\n" + text])
        head = []
        for level in range(1, rng.randrange(1, 4)):
            if own[conv]:
                old = rng.choice(own[conv])
                lines = rng.choice([old.split("\n"), [rng.choice(old.split("\n"))], ["never said here"]])
                head += [">" * level + " " + x.upper() for x in lines]
        own[conv].append(text)
        rows.append((conv, turn, role, "\n".join([*head, text])))
    want = brute_links(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.conv, r.turn): (r.reply_to, r.n_linked) for r in quotation.linked(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == want and sum(v[0] is not None for v in want.values()) > 0.2 * len(rows)


def test_quotations_of_repeated_and_short_lines(spark):
    rows = [(1, 0, "u", "A sentence that is said twice.\nshort ok"), (1, 1, "u", "Between."), (1, 2, "u", "A sentence that is said twice."), (1, 3, "u", "> A sentence that is said twice.\nYes."), (1, 4, "u", "> short ok\nFine."), (1, 5, "u", "x" * 300_000 + "\n> Between.\n" + "y " * 100_000)]
    got = {r.turn: r for r in quotation.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[3].reply_to, got[4].reply_to, got[5].reply_to) == (2, 0, 1) and len(got[5].text) == 500_001


def test_long_reply_chain(spark):
    rows = [(1, 0, "u", "message number zero of the chain")] + [(1, i, "u", f"> {'message number zero of the chain' if i == 1 else f'answer with number {i - 1} in it'}\nanswer with number {i} in it") for i in range(1, 30)]
    got = {r.turn: r for r in quotation.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert all((got[i].reply_to, got[i].depth, got[i].thread_turn) == (i - 1, i, 0) for i in range(1, 30))


def test_quotation_runs_no_python(spark, sf_dir):
    plan = queries.QUERIES["op7_quotation"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


# pipeline


def test_pipeline(spark, sf_dir, documents):
    import corpus_pipeline

    docs = documents
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = staged(stage(spark, docs, sf_dir), name)
        assert out.columns == documents.columns
        seen[name] = {r.doc_id: r.text for r in out.collect()}
        docs = out
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good = [d for d, q in labels.items() if q]
    assert sum(d in seen["quality"] for d in good) > 0.97 * len(good)
    assert set(seen["lines"]) == set(seen["quality"])
    want = brute_lines(sorted({(r.doc_id, r.text) for r in documents.collect() if r.doc_id in seen["quality"]}), 10, "first")
    assert set(seen["lines"].items()) == {(i, t) for (i, _), t in want.items()}
    copies = collections.defaultdict(set)
    for d, t in seen["lines"].items():
        copies[t].add(d)
    assert all(len(own & set(seen["near_duplicates"])) <= 1 for own in copies.values())
    leaks = brute_leaks(list(seen["near_duplicates"].items()), [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()])
    assert set(seen["benchmark"]) == set(seen["near_duplicates"]) - {d for d, _ in leaks}
    assert corpus_pipeline.run(spark, sf_dir).columns == documents.columns
