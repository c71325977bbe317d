"""Fingerprints, components, similarity, decontamination, sharding: against brute force."""

import itertools
import random
import zlib

import pytest
import xxhash


def bits(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.fixture(scope="module")
def texts():
    rnd, words = random.Random(7), [f"w{i}" for i in range(400)]
    out = {1: None, 2: "", 3: " \n", 4: "one", 5: "ONE", 6: "one two"}
    for i in range(10, 40):
        out[i] = " ".join(rnd.choices(words, k=rnd.choice([60, 200])))
    for i, (base, n) in enumerate([(10, 0), (11, 1), (12, 2), (13, 5), (14, 12), (15, 1), (15, 2), (15, 3)], 50):
        w = out[base].split()
        for k in rnd.sample(range(len(w)), n):
            w[k] = "other"
        out[i] = " ".join(w)
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, 0, 0) for i, t in texts.items()] + [(10, texts[10], 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, fingerprint int, node int")


def test_simhash(docs, texts):
    from lexigauge.llm.simhash import simhash_components

    marks = {i: bits(t) for i, t in texts.items()}
    want = reach(texts, [(a, b) for a, b in itertools.combinations(texts, 2) if bin(marks[a] ^ marks[b]).count("1") <= 2])
    got = simhash_components(docs).collect()
    assert len(got) == len(texts) + 1
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{marks[i]:016x}", want[i]) for i in texts}
    assert simhash_components(docs.where("false")).count() == 0


def test_components(spark):
    from lexigauge.llm.graph import components

    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 600)]
    want = reach({x for e in edges for x in e}, edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: want[x] for e in edges if e[0] != e[1] for x in e}


def test_similar(docs, texts):
    from lexigauge.llm.simhash import shingle_hashes
    from lexigauge.llm.simhash_similar import drop_near_duplicates

    sets = {i: set(shingle_hashes(t, 5).tolist()) for i, t in texts.items()}
    alike = lambda a, b: not (sets[a] | sets[b]) or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    want = reach(texts, [(a, b) for a, b in itertools.combinations(texts, 2) if alike(a, b)])
    got = [r.doc_id for r in drop_near_duplicates(docs).collect()]
    assert sorted(got) == sorted(i for i in texts if want[i] == i)
    assert drop_near_duplicates(docs.where("false")).count() == 0


@pytest.mark.parametrize("bits", [0, 3, 10])
def test_similar_whatever_the_counters_say(docs, texts, bits, monkeypatch):
    """The order of shingles decides how much is compared, never what is found: also with counts at random and no counts."""
    import numpy as np

    from lexigauge.llm import simhash_similar as ss

    want = sorted(r.doc_id for r in ss.drop_near_duplicates(docs).collect())
    monkeypatch.setattr(ss, "shingle_counts", lambda rows: np.random.default_rng(bits).integers(0, 9 if bits else 1, 1 << bits).astype(np.uint16))
    assert sorted(r.doc_id for r in ss.drop_near_duplicates(docs).collect()) == want


def test_shared_lines_do_not_crowd(spark):
    """Unrelated texts with one line in common: what they share comes last in the order, so nearly none of it is a key."""
    from lexigauge.llm import simhash_similar as ss
    from lexigauge.llm.simhash import shingle_hashes

    rnd, words = random.Random(9), [f"u{i}" for i in range(5000)]
    line = " ".join(f"shared{k}" for k in range(14))
    texts = [" ".join(rnd.choices(words, k=60)) + " " + line for _ in range(600)]
    rows = spark.createDataFrame([(i, bytearray(str(i).encode()), t) for i, t in enumerate(texts)], "doc_id long, mark binary, text string")
    counts = ss.shingle_counts(rows)
    common = set(shingle_hashes(line, 5).tolist())
    assert all(counts[ss.counters(ss.shingle_set(line))] >= 10)
    keys = [set(ss.prefix(ss.shingle_set(t), 0.8, counts).tolist()) for t in texts]
    assert sum(len(k & common) for k in keys) == 0 and min(map(len, keys)) > 10
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:3])], "doc_id long, text string")
    assert sorted(r.doc_id for r in ss.drop_near_duplicates(docs).collect()) == list(range(600))


def test_temporary_tables_go(spark, docs):
    from pathlib import Path

    from lexigauge.llm.common import scratch
    from lexigauge.llm.simhash_similar import drop_near_duplicates

    folder = Path(scratch(spark, "x").removeprefix("file:")).parent
    names = lambda: {p.name.rsplit("-", 1)[0] for p in folder.iterdir()} if folder.exists() else set()
    for p in list(folder.iterdir()) if folder.exists() else []:
        p.rename(folder.parent / f"old-{p.name}")
    once = docs.dropDuplicates(["doc_id"])
    assert drop_near_duplicates(once).count() > 0 and names() == {"gone", "without"}


def test_every_text_of_a_repeated_id(spark):
    """Two texts of one id are two documents: a copy of one does not take the other with it, and the smallest id stays."""
    from lexigauge.llm.simhash_similar import drop_near_duplicates

    one, two, three = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(5, one, "r"), (5, two, "q"), (5, two, "p"), (2, one + " tail", "s"), (9, three, None), (9, None, "t"), (7, "", "u"), (None, one, "v")]
    got = drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, more string"))
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, [(2, one + " tail", "s"), (5, two, "p"), (9, three, None), (7, "", "u"), (None, one, "v")]))


def test_decontamination(spark):
    from lexigauge.llm.decontamination import benchmark_hits, drop_contaminated

    rnd, words = random.Random(5), [f"v{i}" for i in range(3000)]
    items = [" ".join(rnd.choices(words, k=n)) for n in (6, 9, 14, 20, 40, 3)] + [None, ""]
    clean = [" ".join(rnd.choices(words, k=120)) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(clean)] + [(90, None), (91, "")]
    want = set()
    for k, item in enumerate(items[:5]):
        w = clean[k].split()
        rows.append((100 + k, " ".join(w[:30] + item.upper().replace(" ", ", ").split() + w[30:])))
        want.add((100 + k, k))
    spoilt = items[4].split()
    for k in (5, 15, 25, 35):
        spoilt[k] = "zzz"
    rows += [(200, clean[6] + " " + " ".join(spoilt)), (201, clean[7] + " " + " ".join(items[4].split()[:20]))]
    want |= {(200, 4), (201, 4)}
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows + rows[:1]], "doc_id long, text string, item string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in benchmark_hits(docs, bench).collect()} == want
    assert sorted(r.doc_id for r in drop_contaminated(docs, bench).collect()) == sorted(i for i, _ in rows + rows[:1] if i not in {d for d, _ in want})
    assert benchmark_hits(docs, bench.where("false")).count() == 0 and benchmark_hits(docs.where("false"), bench).count() == 0


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_sharding(spark, docs, texts, shards):
    from lexigauge.llm.sharding import assign_shards

    rows = [*texts.items(), (10, texts[10])]
    got = assign_shards(docs, shards, resolution=5).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    slots, whole, size = {}, {}, {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        whole.setdefault(texts[r.doc_id] or "", set()).add(r.shard)
        size[r.shard] = size.get(r.shard, 0) + r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in whole.values())
    import hashlib

    groups = {}
    for _, t in rows:
        key = hashlib.sha256((t or "").encode()).digest()
        groups[key] = groups.get(key, 0) + len((t or "").encode()) + 16
    order = [groups[k] for k in sorted(groups)]

    def fits(cap):
        n, now = 1, 0
        for g in order:
            if now + g > cap:
                n, now = n + 1, 0
            now += g
        return max(order) <= cap and n <= shards

    assert max(size.values()) == next(c for c in range(1, sum(order) + 1) if fits(c))
    assert assign_shards(docs.where("false"), shards).count() == 0


def test_similar_by_sets_not_repeats(spark):
    """Copies that differ only in how often a line repeats have one shingle set."""
    from lexigauge.llm.simhash_similar import drop_near_duplicates

    rnd, words, rows = random.Random(11), [f"r{i}" for i in range(5000)], []
    for k in range(12):
        body, line = " ".join(rnd.choices(words, k=202)), " ".join(rnd.choices(words, k=10))
        rows += [(2 * k, body + f" {line}" * 2), (2 * k + 1, body + f" {line}" * (6, 10, 19)[k % 3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in drop_near_duplicates(docs).collect()) == [2 * k for k in range(12)]


def test_similar_in_crowded_buckets(spark):
    """Every shingle is shared by many dissimilar texts, so a copy is hardly ever next to its original or first in a bucket."""
    from lexigauge.llm.simhash import shingle_hashes
    from lexigauge.llm.simhash_similar import drop_near_duplicates

    rnd, words, texts = random.Random(12), [f"c{i}" for i in range(9000)], {}
    blocks = [[" ".join(rnd.choices(words, k=20)) for _ in range(2)] for _ in range(20)]
    for k in range(40):
        picks = [rnd.randrange(2) for _ in blocks]
        texts[k] = " ".join(b[x] for b, x in zip(blocks, picks, strict=True))
        picks[k % 20] ^= 1
        texts[100 + k] = " ".join(b[x] for b, x in zip(blocks, picks, strict=True))
    sets = {i: set(shingle_hashes(t, 5).tolist()) for i, t in texts.items()}
    want = reach(texts, [(a, b) for a, b in itertools.combinations(texts, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sum(want[i] != i for i in texts) >= 40
    assert sorted(r.doc_id for r in drop_near_duplicates(docs).collect()) == sorted(i for i in texts if want[i] == i)


def _overlays(doc, item):
    """Largest number of matches and best stretch among the accepted overlays; None without one."""
    found = []
    for shift in range(1 - len(item), len(doc)):
        same = [0 <= shift + i < len(doc) and doc[shift + i] == x for i, x in enumerate(item)]
        now = top = 0
        for s in same:
            now = max(0, now + (1 if s else -2))
            top = max(top, now)
        if 10 * sum(same) >= 7 * len(item) or top >= 12:
            found.append((sum(same), top))
    return found and (max(m for m, _ in found), max(t for _, t in found))


@pytest.mark.parametrize("broadcast", [True, False])
def test_decontamination_finds_what_it_accepts(spark, broadcast, monkeypatch):
    """Random substitutions up to the accepted share and beyond, in items of 1 to 40 tokens: as by laying all shifts."""
    from lexigauge.llm import decontamination

    rnd, words = random.Random(6), [f"v{i}" for i in range(4000)]
    items = {n: rnd.choices(words, k=n) for n in range(1, 41)}
    docs = {}
    for n, item in items.items():
        for k in range(6):
            w = list(item)
            for i in rnd.sample(range(n), min(n, (3 * n // 10) + k // 5)):
                w[i] = "zzz"
            docs[10 * n + k] = rnd.choices(words, k=15) + w + rnd.choices(words, k=rnd.choice([0, 9]))
    docs[1000], docs[None] = rnd.choices(words, k=300) + items[30] * 3, items[12] + items[25]
    docs[1001] = []
    want = {(d, n, *best) for d, doc in docs.items() for n, item in items.items() if set(doc) & set(item) and (best := _overlays(doc, item))}
    assert len(want) >= 5 * len(items)
    table = spark.createDataFrame([(i, " ".join(w), 7) for i, w in docs.items()], "doc_id long, text string, number int")
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()] * 2, "item_id long, text string")
    if not broadcast:
        monkeypatch.setattr(decontamination, "BROADCAST_SEEDS", 0)
    got = decontamination.benchmark_hits(table.unionByName(table.where("doc_id < 60")), bench).collect()
    assert len(got) == len(want) and {(r.doc_id, r.item_id, r.matched, r.stretch) for r in got} == want


def test_masks_miss_nothing():
    """The families chosen for lengths of up to 15: every pattern of as many mismatches as the rule accepts meets a mask."""
    from lexigauge.llm.decontamination import FAMILIES, Overlap, avoidance, unmissable

    chosen = unmissable(Overlap())
    assert chosen[15:] == [0] * len(chosen[15:])
    for n in range(1, 16):
        masks = [m for m in FAMILIES[chosen[n]] if len(m) <= n]
        wrong = n - -(-7 * n // 10)
        for off in itertools.combinations(range(n), wrong):
            hit = any(all(m[j] == "0" or s + j not in off for j in range(len(m))) for m in masks for s in range(n - len(m) + 1))
            assert hit, (n, off)
    assert avoidance(("11",), 4) == [0, 0, 1, 1, 2]


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_links_of_any_radius(spark, radius):
    """Fingerprints crowded around few centres: the links connect what all pairs within the radius connect."""
    from lexigauge.llm.graph import components
    from lexigauge.llm.simhash import links

    rnd = random.Random(radius)
    marks = set()
    for _ in range(4):
        centre = rnd.getrandbits(64)
        for _ in range(40):
            mark = centre
            for bit in rnd.sample(range(64 if radius == 1 else 20), rnd.randrange(4)):
                mark ^= 1 << bit
            marks.add(mark - (1 << 64) if mark >> 63 else mark)
    near = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= radius
    want = reach(marks, [(a, b) for a, b in itertools.combinations(marks, 2) if near(a, b)])
    pairs = links(spark.createDataFrame([(m,) for m in marks], "fingerprint long"), radius)
    assert all(near(r.a, r.b) for r in pairs.collect())
    got = {r.node: r.root for r in components(pairs).collect()}
    assert {m: got.get(m, m) for m in marks} == want


def test_shards_are_even(spark):
    """Groups of like size: no shard is far from its equal share, the last ones included."""
    from lexigauge.llm.sharding import assign_shards

    rnd = random.Random(8)
    docs = spark.createDataFrame([(i, "x" * rnd.randrange(80, 120) + str(i)) for i in range(4000)], "doc_id long, text string")
    size = {}
    for r in assign_shards(docs, 40, resolution=50).collect():
        size[r.shard] = size.get(r.shard, 0) + r.size
    mean = sum(size.values()) / 40
    assert len(size) == 40 and all(abs(n - mean) <= 150 for n in size.values())


def test_similar_starts_from_fingerprints(spark, monkeypatch):
    """Near copies whose fingerprints are close are linked by SimHash; the bucket join is left with the pairs beyond."""
    from lexigauge.llm import simhash_similar as ss
    from lexigauge.llm.simhash import fingerprint, shingle_hashes

    rnd, words, rows = random.Random(21), [f"s{i}" for i in range(5000)], []
    for k in range(12):
        w = rnd.choices(words, k=900)
        rows.append((10 * k, " ".join(w)))
        for i, changed in enumerate((1, 2, 15), 1):
            v = list(w)
            for x in rnd.sample(range(900), changed):
                v[x] = "other"
            rows.append((10 * k + i, " ".join(v)))
    sets = {i: ss.shingle_set(t) for i, t in rows}
    marks = {i: fingerprint(s) for i, s in sets.items()}
    near = {(a, b) for a, b in itertools.combinations(sorted(marks), 2) if (marks[a] ^ marks[b]).bit_count() <= ss.RADIUS}
    seen, apart, verified = [], ss._apart, ss._verified
    monkeypatch.setattr(ss, "_apart", lambda pairs, roots: seen.append({(r.node, r.root) for r in roots.collect()}) or apart(pairs, roots))
    monkeypatch.setattr(ss, "_verified", lambda pairs, *x: seen.append({(r.a, r.b) for r in pairs.collect()}) or verified(pairs, *x))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in ss.drop_near_duplicates(docs).collect()) == [10 * k for k in range(12)]
    first, roots, later = seen[0], dict(seen[1]), seen[2]
    want = reach(marks, near)
    assert len(near) >= 8 and reach(marks, first) == want and {i: roots.get(i, i) for i in marks} == want
    assert later and not [p for p in later if want[p[0]] == want[p[1]]]
