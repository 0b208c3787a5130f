"""Operators against brute force on small fixtures."""

import json
import math
import random
import textwrap
import time
from collections import Counter

import numpy as np
import pytest
import xxhash

from tidelog.llm import chat, decontam, embedding_lsh, licenses, mixing, neartext, quality, sharding, simhash, suffix, toxicity
from tidelog.llm.common import Forest
from tidelog.shipping import ship

WORDS = [f"w{k}" for k in range(60)]


def components(ids, linked):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and root(a) != root(b) and linked(a, b):
                a2, b2 = root(a), root(b)
                up[max(a2, b2)] = min(a2, b2)
    return {i: root(i) for i in ids}


@pytest.fixture(scope="module")
def copies():
    """(id, text): originals, exact copies, edited copies, and texts that share a passage."""
    rng, out = random.Random(5), []
    passage = " ".join(rng.choice(WORDS) for _ in range(30))
    for k in range(120):
        text = [rng.choice(WORDS) for _ in range(rng.randrange(1, 90))]
        if k % 3 == 1 and out:
            text = out[rng.randrange(len(out))][1].split(" ")
            for _ in range(rng.randrange(3)):
                text[rng.randrange(len(text))] = "edited"
        if k % 5 == 2:
            text = [*text[:4], passage, *text[4:]]
        out.append((k * 3 + 1, " ".join(text)))
    return out


@pytest.fixture(scope="module")
def docs(spark, copies):
    ship(spark)
    return spark.createDataFrame(copies, "doc_id long, text string").repartition(4)


def test_substrings(docs, copies):
    seen, want = {}, {}
    for i, t in copies:
        for k in range(len(t) - 49):
            seen.setdefault(t.encode()[k : k + 50], i)
    for i, t in copies:
        b, gone = t.encode(), set()
        for k in range(len(b) - 49):
            if seen[b[k : k + 50]] < i:
                gone |= set(range(k, k + 50))
        spans = [(k, next(e for e in range(k, len(b) + 1) if e not in gone) - k) for k in sorted(gone) if k - 1 not in gone]
        want[i] = (len(b), bytes(x for k, x in enumerate(b) if k not in gone), spans)
    for chunk_bytes, pieces, hot in ((8 << 20, 2048, 256), (900, 16, 256), (900, 3, 2)):
        got = {r["id"]: (r["n_bytes"], bytes(r["kept"]), [tuple(s) for s in r["spans"]]) for r in suffix.repeats(docs, chunk_bytes=chunk_bytes, bucket_pieces=pieces, hot_chunks=hot).collect()}
        assert got == want


@pytest.mark.parametrize("width", [31, 40])
def test_window_tables(width):
    rng = random.Random(width)
    texts = list({bytes(rng.choice(b"ab") for _ in range(rng.randrange(width, width + 20))) for _ in range(40)})
    texts += [t[3:] + b"a" for t in texts if len(t) > width + 3]
    docs = np.arange(len(texts)) * 2 + 1
    got = suffix.least_documents(texts, docs, width)
    for k, t in enumerate(texts):
        for o in range(len(t) - width + 1):
            assert got[k, o] == min(d for u, d in zip(texts, docs, strict=True) if t[o : o + width] in u)


def test_one_gram_in_many_contexts():
    rng, gram, width = random.Random(3), b"the same four and twenty", 50
    lines = [bytes(rng.choices(b"abcdefgh", k=26)) + gram + bytes(rng.choices(b"abcdefgh", k=26)) for _ in range(20_000)]
    texts = list(dict.fromkeys([*lines, *[a[:38] + b[38:] for a, b in zip(lines, lines[1:], strict=False)][:10_000]]))
    docs, home = np.arange(len(texts))[::-1] * 3, np.zeros(len(texts), np.uint64)
    sizes, build = [], suffix.Collection.build
    suffix.Collection.build = staticmethod(lambda symbols, lengths: sizes.append(len(lengths)) or build(symbols, lengths))
    try:
        got = suffix.by_anchor(texts, docs, home, width, 24, 2048)
    finally:
        suffix.Collection.build = build
    assert max(sizes) <= 2 * 2048  # two strings a text
    least: dict[bytes, int] = {}
    for t, d in zip(texts, docs.tolist(), strict=True):
        for k in range(len(t) - width + 1):
            least[t[k : k + width]] = min(d, least.get(t[k : k + width], d))
    assert all(got[i, k] == least[t[k : k + width]] for i, t in enumerate(texts) for k in range(len(t) - width + 1))


def test_collection_order():
    for seed in range(60):
        rng = random.Random(seed)
        texts = sorted({bytes(rng.choice(b"abc"[: 2 + seed % 2]) for _ in range(rng.randrange(1, 20))) for _ in range(12)})
        sizes = np.array([len(t) for t in texts])
        table = np.frombuffer(b"".join(t.rjust(sizes.max(), b"\0") for t in texts), np.uint8).reshape(len(texts), -1).astype(np.uint16) + np.uint16(1)
        found = suffix.Collection.build(table, sizes)
        suffixes = sorted(t[k:] for t in texts for k in range(len(t) + 1))
        common = [0] + [next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b))) for a, b in zip(suffixes, suffixes[1:], strict=False)]
        assert found.lcp.tolist() == common
        rows = {int(a): texts[w][len(texts[w]) - n :] for n, who, at in found.rows(sizes) for w, a in zip(who, at, strict=True)}
        assert all(suffixes[k] == v for k, v in rows.items())


def test_fingerprints(copies):
    for _, text in [*copies[:40], (0, "Éa B\x0bc"), (0, "a"), (0, ""), (0, None)]:
        words = (text or "").encode().lower().split()
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 4]), 42) for k in range(max(1, len(words) - 3))] if words else []
        assert simhash.fingerprint(text, 4) == sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash_components(docs, copies):
    fps = {i: simhash.fingerprint(t, 4) for i, t in copies}
    want = components(list(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    assert {r["id"]: r["component"] for r in simhash.near_duplicates(docs, words=4).collect()} == want


def test_tree_loses_no_pair():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**64, 300, dtype=np.uint64)
    fps = np.unique(np.concatenate([centres] + [centres ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) for _ in range(6)]))
    tree, held = simhash.build(fps[::3], 16)
    home, touched = simhash.route(tree, fps, 4)
    asked = {leaf: set(rows.tolist()) for leaf, rows in touched}
    x, y = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    assert len(held) > 4 and all(a in asked[home[b]] for a, b in zip(x.tolist(), y.tolist(), strict=True))
    a, b = simhash.close_pairs(fps, fps, 4, tile=1 << 12)
    own, other = simhash.stars(fps[x[x != y]], fps[y[x != y]])
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == dict(zip(own.tolist(), other.tolist(), strict=True))


def test_crowded_leaves_are_cut(spark):
    ship(spark)
    rng = np.random.default_rng(8)
    centre = rng.integers(0, 2**64, dtype=np.uint64)
    near = np.array([centre ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, 5, replace=False).astype(np.uint64)) for _ in range(700)])
    fps = np.unique(np.concatenate((near, rng.integers(0, 2**64, 500, dtype=np.uint64))))
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").repartition(3)
    bounds, (simhash.PER_LEAF, simhash.LEAVES) = (simhash.PER_LEAF, simhash.LEAVES), (16, 8)
    try:
        rows = simhash.links(frame, 4).collect()
    finally:
        simhash.PER_LEAF, simhash.LEAVES = bounds
    x, y = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4, 1))
    assert len(x) > 20
    tree, want = Forest(), Forest()
    for r in rows:
        tree.join(r["a"], r["b"])
    for a, b in zip(fps.view(np.int64)[x].tolist(), fps.view(np.int64)[y].tolist(), strict=True):
        want.join(a, b)
    assert {a: tree.root(a) for a in fps.view(np.int64).tolist()} == {a: want.root(a) for a in fps.view(np.int64).tolist()}


def test_near_pairs_are_the_gate(copies):
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 2**63, (4, 6), dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (4, 3000), dtype=np.uint64)
    bits = np.concatenate((np.repeat(centres, 500, axis=1) ^ flips, rng.integers(0, 2**63, (4, 1500), dtype=np.uint64)), axis=1)
    size, every, seen = np.full(bits.shape[1], 40) + rng.integers(0, 3, bits.shape[1]), np.arange(bits.shape[1]), []
    pairs = lambda found: {(min(a, b), max(a, b)) for x, y in found for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    want = pairs(neartext.candidates(bits, size, every, every, 0.8))
    assert pairs(neartext.near_pairs(bits, size, every, every, 0.8, 1 << 14, seen)) == want and len(want) > 100_000
    assert sum(seen) < 0.7 * bits.shape[1] ** 2  # balls around copies prune, unlike texts do not
    pure = rng.integers(0, 2**63, (4, 800), dtype=np.uint64)
    seen.clear()
    assert pairs(neartext.near_pairs(pure, size[:800], every[:800], every[:800], 0.8, 1 << 14, seen)) == set() and sum(seen) == 800**2


def test_recall_of_the_gate(spark):
    """Pairs of similarity 0.8 and a little more, of sets of all sizes; every link that brute force has is found."""
    ship(spark)
    rng, rows = random.Random(17), []
    for k in range(900):
        words = [f"t{k}w{i}" for i in range(rng.choice([9, 14, 24, 49, 94, 200]))]
        edited = list(words)
        for _ in range(1 + len(words) // 60):
            edited[rng.choice([0, -1, len(words) // 2])] = f"x{rng.randrange(10**9)}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(edited))]
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, t in rows if (w := t.split())}
    alike = {i for i in sets if i % 2 == 0 and len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])}
    got = {r["id"]: r["component"] for r in neartext.groups(spark.createDataFrame(rows, "doc_id long, text string"), block=256).collect()}
    assert len(alike) > 250 and {i for i in sets if i % 2 == 0 and got[i + 1] == i} == alike


def test_similar_texts(docs, copies):
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in copies if (w := t.lower().split())}
    want = components(list(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    for block in (4096, 16):
        assert {r["id"]: r["component"] for r in neartext.groups(docs, block=block).collect()} == want


def test_tiles():
    def slow(text, item, least):
        used_t, used_p, out = [x < 0 for x in text], [x < 0 for x in item], []
        while True:
            best, found = least - 1, []
            for p in range(len(item)):
                for t in range(len(text)):
                    n = 0
                    while t + n < len(text) and p + n < len(item) and text[t + n] == item[p + n] and not used_t[t + n] and not used_p[p + n]:
                        n += 1
                    if n > best:
                        best, found = n, [(p, t)]
                    elif n == best and n >= least:
                        found.append((p, t))
            if not found:
                return sorted(out)
            for p, t in found:
                if not any(used_t[t : t + best]) and not any(used_p[p : p + best]):
                    used_t[t : t + best], used_p[p : p + best] = [True] * best, [True] * best
                    out.append((t, p, best))

    for seed in range(300):
        rng = random.Random(seed)
        text, item = ([rng.randrange(4) for _ in range(rng.randrange(1, 50))] for _ in range(2))
        assert sorted(decontam.tile(text, item, 4)) == slow(text, item, 4)


def test_tiles_of_repeated_tokens():
    began = time.perf_counter()
    assert decontam.tile([7] * 4000, [7] * 60, 5) == [(0, 0, 60)]
    assert sum(n for _, _, n in decontam.tile([1, 2] * 3000, [1, 2] * 100 + [3] + [2, 1] * 50, 5)) == 300
    assert time.perf_counter() - began < 2


def test_leaks(spark):
    ship(spark)
    rng = random.Random(9)
    items = [(k, " ".join(rng.choice(WORDS) for _ in range(24)) + ".") for k in range(30)]
    noise = lambda: " ".join(rng.choice(WORDS) for _ in range(40))
    docs, want = [], set()
    for k, text in items:
        w = text.split()
        docs += [(10 * k, noise()), (10 * k + 1, f"{noise()} {text.upper()} {noise()}"), (10 * k + 2, " ".join([noise(), *w[12:], noise(), *w[:12]])), (10 * k + 3, " ".join([noise(), *w[:10], noise()]))]
        want |= {(10 * k + 1, k), (10 * k + 2, k)}
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contaminated(frame, bench).collect()
    assert {(r["id"], r["item"]) for r in got} == want
    assert {r["doc_id"] for r in decontam.clean(frame, bench).collect()} == {i for i, _ in docs} - {i for i, _ in want}
    whole, decontam.BLOCK_BYTES = decontam.BLOCK_BYTES, 500
    try:
        assert {(r["id"], r["item"]) for r in decontam.contaminated(frame, bench).collect()} == want
        twice = frame.union(frame).withColumn("_first", frame["doc_id"])
        assert Counter(r["doc_id"] for r in decontam.clean(twice, bench).collect()) == Counter(2 * sorted({i for i, _ in docs} - {i for i, _ in want}))
    finally:
        decontam.BLOCK_BYTES = whole


def test_tree_moves_only_into_new_shards(spark):
    keys = spark.range(3000).selectExpr("id as doc_id", "cast(id as string) as text")
    got = sharding.shard(keys, sharding.uniform_tree(24), sharding.uniform_tree(26)).collect()
    assert {r["shard"] for r in got} == set(range(24))
    moved = [r for r in got if r["shard"] != r["grown_shard"]]
    assert moved and {r["grown_shard"] for r in moved} == {24, 25} and len(moved) < 400
    heavy = [sharding.Leaf(x.shard, x.region, x.rack, 3.0 if x.shard == 5 else 1.0) for x in sharding.uniform_tree(24)]
    for r in sharding.shard(keys, sharding.uniform_tree(24), heavy).collect():
        assert r["shard"] == r["grown_shard"] or r["grown_shard"] // 12 == 0  # rows move only into the region that gained


def test_mix(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(["w"] * rng.randrange(0, 40)), rng.choice(["a", "b", "c", None, "z"])) for k in range(400)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    order = [*sorted(s for s in sizes if s), None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, goal, left = 1.5 * sum(sizes.values()), {}, list(order)
    while left:
        level = (total - sum(goal.values())) / sum(weight[s] for s in left)
        over = [s for s in left if level * weight[s] > 2 * sizes[s]]
        if not over:
            goal |= {s: level * weight[s] for s in left}
            break
        goal |= {s: 2.0 * sizes[s] for s in over}
        left = [s for s in left if s not in over]
    taken = Counter()
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(goal[r["source"]])
        taken[r["source"]] += r["taken"]
    assert all(taken[s] == int(goal[s] + 1e-6) for s in order)
    mixed = Counter()
    for r in mixing.mixed_rows(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        mixed[r["source"]] += len(r["text"].split())
    assert mixed == taken


def test_quality_learns_faults(spark):
    ship(spark)
    rng = random.Random(4)
    rows = []
    for k in range(600):
        words = [rng.choice(["the", "of", "an", "river", "stone", "lantern", "is", "quiet", "mill", f"word{rng.randrange(300)}"]) for _ in range(rng.randrange(25, 90))]
        text = " ".join(words[:10]) + ". " + ", ".join(" ".join(words[a : a + 6]) for a in range(10, len(words), 6)) + "."
        kind = k % 12
        text = {0: " ".join(w + "###" for w in words), 1: " ".join(w for w in words[:6] for _ in range(12)), 2: " ".join(w.upper() + "!!" for w in words)}.get(kind, text)
        rows.append((k, text, kind > 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string, good boolean")
    got = {r["id"]: r["keep"] for r in quality.score(docs, quality.fit(docs)).collect()}
    assert sum(got[i] == g for i, _, g in rows) >= 590 and all(got[i] for i, _, g in rows if g)


def slow_votes(text):
    """The nine labellers on one text, in plain Python."""
    words, share = text.split(), lambda k, n: k / max(n, 1)
    letter = lambda c: "a" if c.islower() or ord(c) > 127 else "A" if c.isupper() else ""
    size, n = len(text.encode()), len(words)
    width = lambda w: len(w.encode())
    upper, lower = sum(c.isascii() and c.isupper() for c in text), sum(len(c.encode()) if ord(c) > 127 else c.islower() for c in text)
    odd = share(sum(c in "!#$%&*+=<>^~\\`[]{}|" for c in text), size)
    same = share(sum(a == b for a, b in zip(words, words[1:], strict=False)), n)
    lines = [x for x in text.split("\n") if x]
    repeated = share(len(lines) - len(set(lines)), len(lines))
    caps, stops = share(upper, upper + lower), share(sum(w[-1] in ".," for w in words), n)
    short, mean = share(sum(width(w) <= 3 and any(map(letter, w)) for w in words), n), share(sum(map(width, words)), n)
    fresh = share(len(set(zip(words, words[1:], strict=False))), n - 1)
    vote = lambda good, bad: "b" if bad else "g" if good else "-"
    return "".join((
        vote(odd < 0.01, odd > 0.04), vote(n >= 20 and same < 0.03, n >= 3 and same > 0.2), vote(len(lines) >= 3 and repeated < 0.1, len(lines) >= 3 and repeated > 0.4),
        vote(caps < 0.15, upper + lower >= 8 and caps > 0.4), vote(n >= 30, n < 1), vote(n >= 20 and 0.03 < stops < 0.5, n >= 20 and stops < 0.01),
        vote(n >= 20 and short > 0.15, n >= 20 and short < 0.05), vote(n > 0 and 2.5 <= mean <= 9, mean > 14 or (n > 0 and mean < 1.5)), vote(n >= 6 and fresh > 0.8, n >= 6 and fresh < 0.5),
    ))


def test_votes_and_labels_by_plain_loops():
    rng = random.Random(14)
    pick = lambda: rng.choice(["the", "of", "River", "STONE", "a.", "an,", "###", "w!!", "\u00e9t\u00e9", "x", "lantern", "7", "|", "averyveryverylongword"])
    texts = ["", " \n ", "one"] + [rng.choice([" ", "\n", "  "]).join((w := pick()) if rng.random() < 0.7 else f"{w} {w}" if (w := pick()) else w for _ in range(rng.randrange(1, 70))) for _ in range(300)]
    texts += ["\n".join(["same line here"] * k + ["other line"]) for k in range(6)]
    votes = quality.Batch([t.encode() for t in texts]).votes()
    assert ["".join("bg-"[v] for v in row) for row in votes] == [slow_votes(t) for t in texts]
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.fit_labels(patterns, counts.astype(float), steps=25)
    prior, chance, weight = [0.15, 0.85], [[[0.25, 0.75], [0.005, 0.995]][c] for c in (0, 1)], max(2.0, 0.002 * len(texts))
    start, chance = chance, [[list(c)] * 9 for c in chance]
    for _ in range(25):
        mass = []
        for row in votes:
            p = [prior[c] * math.prod(chance[c][j][v] for j, v in enumerate(row) if v < 2) for c in (0, 1)]
            mass.append([x / sum(p) for x in p])
        chance = [[[(weight * start[c][v] + sum(m[c] for m, row in zip(mass, votes, strict=True) if row[j] == v)) for v in (0, 1)] for j in range(9)] for c in (0, 1)]
        chance = [[[x / sum(pair) for x in pair] for pair in own] for own in chance]
        prior = [(sum(m[c] for m in mass) + 1) / (len(texts) + 2) for c in (0, 1)]
    assert model.chance == pytest.approx(np.array(chance), abs=1e-6) and model.prior == pytest.approx(np.array(prior), abs=1e-6)


def test_toxicity_by_plain_counts(spark):
    """Counts, ratios, choice of features and scores with dictionaries; only the fit of the weights is shared."""
    ship(spark)
    rng = random.Random(21)
    rows = [(k, " ".join(rng.choice(["Stra\u00dfe", "\u6f22\u5b57", "river", "mill", "\U0001f600", "vile", "rotten"][: 5 if k % 4 else 7]) for _ in range(rng.randrange(1, 9))), int(k % 4 == 0)) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r["id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, docs)).collect()}
    kept_out = {r["doc_id"] for r in docs.where(toxicity.held_out(docs["doc_id"])).collect()}

    def features(text):
        c, out = [ord(x) for x in f" {text.lower()} "], set()
        for i, n in enumerate((3, 4, 5, 6)):
            for at in range(len(c) - n + 1):
                h = 0
                for x in c[at : at + n]:
                    h = (h * 0xD6E8FEB86659FD93 + x) % 2**64
                out.add((h * 0x9E3779B97F4A7C15 % 2**64 >> 46) + (i << 18))
        return out

    has = {i: features(t) for i, t, _ in rows}
    train = [(i, y) for i, _, y in rows if i not in kept_out]
    p, q, n1 = Counter(), Counter(), sum(y for _, y in train)
    for i, y in train:
        (p if y else q).update(has[i])
    n0, ratio = len(train) - n1, {}
    for f in {*p, *q}:
        if p[f] + q[f] >= 5:
            r = math.log((p[f] + 1) / (n1 + 2)) - math.log((q[f] + 1) / (n0 + 2))
            ratio[f] = (r, abs(r) / math.sqrt(1 / (p[f] + 1) + 1 / (q[f] + 1)))
    best = sorted(ratio, key=lambda f: (-ratio[f][1], f))
    best = best[: max(512, sum(ratio[f][1] >= 4 for f in best))]
    order = sorted(train, key=lambda x: x[0])
    at = [(k, best.index(f)) for k, (i, _) in enumerate(order) for f in sorted(has[i]) if f in set(best)]
    r = np.array([ratio[f][0] for f in best])
    w, bias = toxicity.fit_logistic(np.array([a for a, _ in at]), np.array([b for _, b in at]), r[[b for _, b in at]], np.array([y for _, y in order], float), len(best), 3e-3, 150, 0.05)
    for i in list(has)[:80]:
        z = bias + sum(w[k] * r[k] for k, f in enumerate(best) if f in has[i])
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4)


def test_toxicity_generalises(spark):
    ship(spark)
    rng = random.Random(6)
    rows = []
    for k in range(900):
        words, bad = [rng.choice(WORDS) + rng.choice("aeiou") for _ in range(rng.randrange(5, 60))], k % 6 == 0
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["nasty", "vile", "rotten"])
        rows.append((k, " ".join(words), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int")
    model = toxicity.fit(docs, docs.selectExpr("doc_id", "y as toxic", "text"))
    got = toxicity.score(docs, model).join(docs.select("doc_id", "y", toxicity.held_out(docs["doc_id"]).alias("out")), toxicity.F.col("doc_id") == toxicity.F.col("id")).where("out").collect()
    assert len(got) > 150 and sum((r["score"] >= 0.3) == bool(r["y"]) for r in got) >= 0.97 * len(got)


def test_licenses(spark):
    ship(spark)
    rng = random.Random(8)
    notices = [(n, t) for n, own in licenses.TEMPLATES.items() for t in own]
    rows = [(k, "\n".join([" ".join(rng.choice(WORDS) for _ in range(9)), notices[k % len(notices)][1] if k % 2 else "the river and the mill of the town", " ".join(rng.choice(WORDS) for _ in range(9))])) for k in range(120)]
    rows.append((500, "Licensed under the terms of the Zebra agreement, version 9."))
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["id"], r["paragraph"], r["family"]) for r in got if r["confirmed"]} == {(k, 1, notices[k % len(notices)][0]) for k in range(120) if k % 2}
    assert {(r["id"], r["family"]) for r in got if not r["confirmed"]} == {(500, "unknown")}


def test_wrapped_notices(spark):
    ship(spark)
    heads = {
        "mit": licenses.TEMPLATES["mit"][2], "apache-2.0": licenses.TEMPLATES["apache-2.0"][2], "gpl-3.0": licenses.TEMPLATES["gpl-3.0"][1],
        "gpl-2.0": licenses.TEMPLATES["gpl-2.0"][1], "bsd": licenses.TEMPLATES["bsd"][1], "isc": licenses.TEMPLATES["isc"][0],
    }
    rng, rows, want = random.Random(31), [], set()
    plain = lambda: " ".join(rng.choice(WORDS) for _ in range(9))
    for k, (family, text) in enumerate(heads.items()):
        for m, sign in enumerate(("", "# ", " * ", "// ", "-- ")):
            body = [sign + line for line in textwrap.wrap(text, 44)]
            rows.append((10 * k + m, "\n".join([plain(), sign.rstrip(), *body, sign.rstrip(), plain(), plain()])))
            want.add((10 * k + m, 2, len(body), family))
    rows += [(900 + k, "\n".join(plain() for _ in range(30))) for k in range(20)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["id"], r["paragraph"], r["lines"], r["family"]) for r in got} == want and all(r["confirmed"] for r in got)


def test_license_chances_by_dictionaries():
    model, rng = licenses.train(["the river ran by the mill", "stone and lantern"]), random.Random(2)
    names = {i: w for w, i in model.vocabulary.items()}
    single = {names[i]: model.single[i] for i in names}
    double = {(names[c // len(names)], names[c % len(names)]): model.double[k] for k, c in enumerate(model.pairs.tolist())}
    texts = [licenses.words_of(t) for own in licenses.TEMPLATES.values() for t in own] + [[rng.choice([*names.values(), "other"]) for _ in range(rng.randrange(12))] for _ in range(60)]
    ids = np.array([model.vocabulary.get(w, -1) for t in texts for w in t], np.int64)
    got = model.chances(ids, np.repeat(np.arange(len(texts)), [len(t) for t in texts]), len(texts))
    for words, row in zip(texts, got, strict=True):
        total = sum((single[w] for w in words if w in single), np.zeros(len(licenses.FAMILIES))) + sum((double[p] for p in zip(words, words[1:], strict=False) if p in double), np.zeros(len(licenses.FAMILIES)))
        e = np.exp((total / math.sqrt(max(1, len(words))) + model.bias) / model.temperature)
        assert row == pytest.approx(e / e.sum(), abs=1e-9)


def test_vectors_under_one_id(spark):
    ship(spark)
    rng = np.random.default_rng(4)
    base = rng.standard_normal((25, 12))
    rows = np.concatenate((base, base + rng.standard_normal((25, 12)) * 0.05, base[:9], base[:9] * 2))
    ids = [k % 17 for k in range(len(rows))]
    unit = rows / np.linalg.norm(rows, axis=1)[:, None]
    near = (unit @ unit.T >= 0.95) & ~np.eye(len(rows), dtype=bool)
    part = components(range(len(rows)), lambda a, b: near[a, b])
    want = Counter((ids[k], int(near[k].sum()), min(ids[j] for j in part if part[j] == part[k])) for k in range(len(rows)))
    frame = spark.createDataFrame([(ids[k], v.tolist()) for k, v in enumerate(rows)], "vec_id long, embedding array<double>")
    assert Counter((r["id"], r["n_links"], r["component"]) for r in embedding_lsh.near_vectors(frame, block=8).collect()) == want


def test_vectors_at_every_distance(spark):
    ship(spark)
    rng = np.random.default_rng(1)
    base = rng.standard_normal((150, 24))
    rows = np.concatenate((base, base[:100] + rng.standard_normal((100, 24)) * np.linspace(0, 0.5, 100)[:, None], base[:60] + rng.standard_normal((60, 24)) * 0.05, np.tile(base[0], (80, 1)) + rng.standard_normal((80, 24)) * 0.02))
    unit = rows / np.linalg.norm(rows, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)], "vec_id long, embedding array<double>")
    got = {r["id"]: r for r in embedding_lsh.near_vectors(frame, block=32).collect()}
    assert sum(got[k]["n_links"] for k in got) >= 0.99 * near.sum()
    assert all(got[k]["n_links"] <= near[k].sum() for k in got)


def test_links_and_order(spark):
    ship(spark)
    tools = {"add": {"type": "object", "properties": {"a": {"type": ["integer", "string"], "reference": True}, "b": {"type": "number"}}, "required": ["a"], "additionalProperties": False}}
    m = [
        ("c", 0, "user", None, None, None, "hi"),
        ("c", 1, "call", "x", "add", '{"b":2.5, "a":1}', None),
        ("c", 2, "call", "y", "add", '{"a":"$result:z"}', None),
        ("c", 3, "result", "x", None, None, "3.5"),
        ("c", 4, "call", "z", "add", '{"a":"$result:x"}', None),
        ("c", 5, "result", "z", None, None, "1"),
        ("c", 6, "result", "y", None, None, "2"),
        ("c", 7, "call", "x", "add", '{"a":9}', None),
        ("c", 8, "result", "q", None, None, "?"),
        ("c", 9, "call", "p", "add", '{"a":1.5}', None),
        ("c", 10, "call", "o", "mul", "{}", None),
        ("c", 11, "call", "n", "add", "{oops", None),
        ("d", 1, "call", "u", "add", '{"a":"$result:v"}', None),
        ("d", 2, "call", "v", "add", '{"a":"$result:u"}', None),
        ("d", 3, "result", "u", None, None, ""),
        ("d", 4, "result", "v", None, None, ""),
    ]
    rows = chat.link(spark.createDataFrame(m, "conv string, turn long, kind string, call_id string, name string, arguments string, content string"), tools).collect()
    by = {(r["conv"], r["turn"]): r for r in rows}
    assert by["c", 1]["status"] == "ok" and by["c", 1]["linked_turn"] == 3 and by["c", 3]["linked_turn"] == 1
    assert by["c", 1]["json"] == '{"role":"assistant","tool_calls":[{"function":{"arguments":"{\\"a\\":1,\\"b\\":2.5}","name":"add"},"id":"x","type":"function"}]}'
    assert [by["c", t]["status"] for t in (7, 8, 9, 10, 11)] == ["duplicate_id", "orphan_result", "no_result,type:.a", "no_result,unknown_tool", "no_result,bad_json"]
    order = [r["turn"] for r in sorted((r for r in rows if r["conv"] == "c"), key=lambda r: (r["slot"], r["level"], r["turn"]))]
    assert order.index(2) > order.index(5) > order.index(4) > order.index(3) and order.index(6) > order.index(2)
    assert {by["d", t]["status"] for t in (1, 2)} == {"cycle"}




def slow_order(calls, results, refs):
    """(slot, level) of each call, None in or behind a cycle: longest waits by recursion."""
    def place(c, seen):
        if c in seen:
            raise RecursionError
        best = (calls[c], 0)
        for d in refs.get(c, ()):
            if d in calls and d in results:
                s, l = place(d, {*seen, c})
                best = max(best, (max(s, results[d]), (0 if results[d] > s else l + 1) + 1))
        return best

    out = {}
    for c in calls:
        try:
            out[c] = place(c, set())
        except RecursionError:
            out[c] = None
    return out


def test_order_of_random_references(spark):
    ship(spark)
    tools = {"t": {"type": "object", "properties": {"a": {"type": "array", "items": {"type": "string", "reference": True}}, "p": {"type": "string"}}}}
    rows, want = [], {}
    for conv in range(14):
        rng = random.Random(conv)
        n = rng.randrange(1, 9)
        turns = rng.sample(range(40), 2 * n)
        calls, results = {f"k{i}": turns[2 * i] for i in range(n)}, {f"k{i}": turns[2 * i + 1] for i in range(n) if rng.random() < 0.9}
        refs = {c: rng.sample([*calls, "gone"], rng.randrange(0, 3) if n > 1 else 1) for c in calls}
        own = None if conv == 3 else conv
        rows += [(own, t, "call", c, "t", json.dumps({"a": ["$result:" + r for r in refs[c]], "p": "$result:k0"}), None) for c, t in calls.items()]
        rows += [(own, t, "result", c, None, None, "x") for c, t in results.items()]
        want |= {(own, c): p for c, p in slow_order(calls, results, refs).items()}
    frame = spark.createDataFrame(rows, "conv long, turn long, kind string, call_id string, name string, arguments string, content string")
    got = {(r["conv"], r["call_id"]): None if r["status"] == "cycle" else (r["slot"], r["level"]) for r in chat.link(frame, tools).collect() if r["kind"] == "call"}
    assert got == want and None in want.values()


def test_rounds_do_not_grow_with_calls(spark, monkeypatch):
    ship(spark)
    tools, made = {"t": {"type": "object", "properties": {"a": {"type": "string", "reference": True}}}}, []
    one = chat.written
    monkeypatch.setattr(chat, "written", lambda df: made.append(1) or one(df))
    rows = [(0, 1, "call", "s", "t", '{"a":"$result:s"}', None), (0, 2, "result", "s", None, None, "")]
    more = [r for c in range(60) for r in ((c // 50, 10 * c + 3, "call", f"x{c}", "t", f'{{"a":"$result:{"xy"[c % 2]}{c}"}}', None), (c // 50, 10 * c + 4, "result", f"x{c}", None, None, ""), (c // 50, 10 * c + 5, "call", f"y{c}", "t", "{}", None), (c // 50, 10 * c + 6, "result", f"y{c}", None, None, ""))]
    counts = []
    for own in (rows, rows + more):
        made.clear()
        got = chat.link(spark.createDataFrame(own, "conv long, turn long, kind string, call_id string, name string, arguments string, content string"), tools).collect()
        assert {r["call_id"] for r in got if r["status"] == "cycle"} == {"s"} | {f"x{c}" for c in range(0, 60, 2) if len(own) > 2}
        counts.append(len(made))
    assert counts[0] <= counts[1] <= counts[0] + 1 <= 9


def test_calls_that_json_or_utf8_cannot_hold(spark):
    ship(spark)
    tools = {"t": {"type": "object", "properties": {"a": {}}}, "odd": {"type": "date"}}
    args = ['{"a":1e999}', '{"a":"\\ud800"}', '{"a":NaN}', "[" * 100_000, "null", None, '{"a":' + "9" * 5000 + "}", '{"a":"' + "x" * 2_000_000 + '"}']
    rows = [(1, k, "call", f"c{k}", "t", a, None) for k, a in enumerate(args)] + [(1, 50, "call", "o", "odd", "{}", None), (1, 51, "call", "p", "other", "{oops", None)]
    got = {r["turn"]: r["status"].split(",")[-1] for r in chat.link(spark.createDataFrame(rows, "conv long, turn long, kind string, call_id string, name string, arguments string, content string"), tools).collect()}
    assert [got[k] for k in (0, 1, 2, 3, 5, 6)] == ["bad_json"] * 6 and got[4] == "type:." and got[7] == "no_result" and got[50] == "schema:." and got[51] == "unknown_tool"
