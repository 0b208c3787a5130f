"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import hashlib
import random
from math import comb

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidelog.llm import chat, common, decontam, embedding_lsh, licenses, mixing, neartext, quality, sharding, simhash, suffix, toxicity
from tidelog.shipping import ship

LONG = "alpha beta gamma delta " * 40_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, size long, slot int, taken int, key string, score double, s int, r int, start int, _leader long, node long, chunk int, votes int"
TEXTS = [(1, "one two three four five six seven. Eight nine ten."), (2, None), (3, ""), (4, "   \n\t "), (5, LONG), (6, LONG), (None, "null id text with some more words here"), (None, None), (2**60 + 1, "big id"), (7, "tie"), (7, "tie"), (7, "tie other"), (8, "\x00 nul and é ß 漢字 words"), (9, "x")]


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    rows = [(i, t, "en", [None, "b", "a", "\U0001f600"][k % 4], len(t or ""), 0, 0, 0, 0, "k", 0.0, 1, 2, 3, 4, 5, 6, 7) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "eight nine"), (3, "eight nine"), (None, "one two three four five six seven")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 1, 1), (6, None, None), (7, 1, 1), (7, 1, 0), (None, 0, 1), (77, 0, 1)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "suffix": (lambda d, b, y: suffix.repeats(d), True),
    "simhash": (lambda d, b, y: simhash.near_duplicates(d), True),
    "neartext": (lambda d, b, y: neartext.groups(d), True),
    "sharding": (lambda d, b, y: sharding.shard(d, sharding.uniform_tree(24), sharding.uniform_tree(25)), True),
    "mixing": (lambda d, b, y: mixing.mix(d), True),
    "quality": (lambda d, b, y: quality.score(d, quality.fit(d)), True),
    "toxicity": (lambda d, b, y: toxicity.score(d, toxicity.fit(d, y)), True),
    "decontam": (lambda d, b, y: decontam.contaminated(d, b), False),
    "licenses": (lambda d, b, y: licenses.scan(d), False),
    "mixed_rows": (lambda d, b, y: mixing.mixed_rows(d), False),
    "deduplicated": (lambda d, b, y: neartext.deduplicated(d), False),
    "clean": (lambda d, b, y: decontam.clean(d, b), False),
    "kept": (lambda d, b, y: quality.kept(d, quality.fit(d)), False),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edges(name, docs, bench, labels):
    make, each = OPERATORS[name]
    got = make(docs, bench, labels).collect()
    assert len(got) == len(TEXTS) if each else len(got) <= 3 * len(TEXTS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(name, docs, bench, labels):
    assert OPERATORS[name][0](docs.where("false"), bench.where("false"), labels.where("false")).collect() == []


@pytest.mark.parametrize("name", ["toxicity", "decontam", "clean"])
def test_empty_second_table(name, docs, bench, labels):
    assert len(OPERATORS[name][0](docs, bench.where("false"), labels.where("false")).collect()) == (0 if name == "decontam" else len(TEXTS))


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages(k, spark, docs, bench, tmp_path):
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for own in (plain, plain.where("false")):
        got = corpus_pipeline.STAGES[k][1](spark, own, str(tmp_path))
        rows = got.count()
        assert rows <= 2 * len(TEXTS)
        assert k == len(corpus_pipeline.STAGES) - 1 or got.columns == plain.columns


NAMES = "Size long, SHARD int, Target double, Taken long, _mix_c0 int, _mix_taken long, _shard_c1 string, _shard_n int, Law string"


@pytest.mark.parametrize("name", ["sharding", "mixing", "mixed_rows", "deduplicated", "clean", "kept", "suffix", "simhash", "neartext", "quality", "toxicity", "decontam", "licenses"])
def test_columns_of_any_name(name, spark, bench, labels):
    ship(spark)
    rows = [(k, " ".join(f"word{k}x{i}" for i in range(40)) + ".", "en", "ab"[k % 2], 777, 1, 0.5, 3, 4, 5, "s", 6, "l") for k in range(12)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {NAMES}")
    got = OPERATORS[name][0](docs, bench, labels)
    if name in ("mixed_rows", "deduplicated", "clean", "kept"):
        assert got.schema.names == docs.schema.names
        assert all(tuple(r)[4:] == rows[0][4:] for r in got.collect())
    elif name in ("sharding", "mixing"):
        found = got.collect()
        assert len(found) == len(rows) and len({c.lower() for c in got.columns}) == len(got.columns)
        assert all(r["size"] != 777 and r["_mix_c0"] == 4 and r["_shard_c1"] == "s" and r["_mix_taken"] == 5 and r["_shard_n"] == 6 for r in found)
        assert name == "mixing" or all(r["law"] == "key" and r["Target"] == 0.5 for r in found)
    else:
        got.collect()


def test_values_of_edges(spark, docs, bench, labels):
    """What nulls, empty and long texts, ties and repeated rows give, not only how many."""
    ids = [i for i, _ in TEXTS]
    shards = {(r["doc_id"], r["size"]): r for r in OPERATORS["sharding"][0](docs, bench, labels).collect()}
    assert shards[2, 8]["text_crc32"] == 0 and len({r["shard"] for (i, _), r in shards.items() if i is None}) == 1
    mixed = {(r["doc_id"], r["size"]): r["taken"] for r in OPERATORS["mixing"][0](docs, bench, labels).collect()}
    assert mixed[2, 0] == mixed[3, 0] == mixed[4, 0] == mixed[None, 0] == 0 and all(0 <= t <= 2 * n for (_, n), t in mixed.items())
    cuts = {(r["id"], r["n_bytes"]): (len(r["kept"]), len(r["spans"])) for r in OPERATORS["suffix"][0](docs, bench, labels).collect()}
    assert cuts[2, 0] == cuts[3, 0] == (0, 0) and cuts[5, len(LONG)] == (len(LONG), 0) and cuts[6, len(LONG)] == (0, 1)
    near = {(r["id"], r["fp"]): r["component"] for r in OPERATORS["simhash"][0](docs, bench, labels).collect()}
    assert near[2, 0] == near[3, 0] == near[4, 0] == near[None, 0] == 2 and {c for (i, f), c in near.items() if i in (5, 6)} == {5}
    groups = {(r["id"], r["t"]): r["component"] for r in OPERATORS["neartext"][0](docs, bench, labels).collect()}
    assert {c for (i, _), c in groups.items() if i in (2, 3, 4)} == {2} and {c for (i, _), c in groups.items() if i in (5, 6)} == {5} and sorted(c for (i, _), c in groups.items() if i == 7) == [7, 7]
    scores = {(r["id"], r["votes"]): (r["score"], r["keep"]) for r in OPERATORS["quality"][0](docs, bench, labels).collect()}
    assert {s for (i, _), s in scores.items() if i in (2, 3, 4)} == {(0.0, False)} and len({s for (i, _), s in scores.items() if i in (5, 6)}) == 1
    toxic = [(r["id"], r["score"]) for r in OPERATORS["toxicity"][0](docs, bench, labels).collect()]
    assert all(0 <= s <= 1 for _, s in toxic) and len({s for i, s in toxic if i in (2, 3)}) == 1 and len({s for i, s in toxic if i in (5, 6)}) == 1
    assert {(r["id"], r["item"]) for r in OPERATORS["decontam"][0](docs, bench, labels).collect()} == {(1, 3), (1, None)}
    assert sorted(str(r["doc_id"]) for r in OPERATORS["clean"][0](docs, bench, labels).collect()) == sorted(str(i) for i in ids if i != 1)
    dedup = sorted(str(r["doc_id"]) for r in OPERATORS["deduplicated"][0](docs, bench, labels).collect())
    assert dedup == sorted(["1", "2", "5", "7", "8", "9", str(2**60 + 1), "None"])


def slow_pipeline(spark, rows, items):
    """The pipeline's rows in plain Python, but for the quality scores: (doc_id, words)."""
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    keep = {r["id"] for r in quality.score(frame, quality.fit(frame)).collect() if r["keep"]}
    left = [r for r in rows if r[0] in keep]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t, *_ in left if (w := t.lower().split())}
    up = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = up[a], up[b]
                up = {i: min(x, y) if c in (x, y) else c for i, c in up.items()}
    left = [r for r in left if up[r[0]] == r[0]]
    bare = lambda t: decontam.tokens(t)
    left = [r for r in left if not any(covered(bare(r[1]), bare(t)) >= 0.8 * len(bare(t)) for t in items)]
    sizes = {s: sum(len(r[1].split()) for r in left if r[3] == s) for s in sorted({r[3] for r in left})}
    weight, goal, open_ = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sizes)}, {}, list(sizes)
    while open_:
        level = (1.5 * sum(sizes.values()) - sum(goal.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 2 * sizes[s]]
        goal |= {s: 2.0 * sizes[s] for s in over} if over else {s: level * weight[s] for s in open_}
        open_ = [s for s in open_ if s not in over] if over else []
    out = []
    for s, total in sizes.items():
        own = sorted((hashlib.md5(f"mix:{r[0]}".encode()).hexdigest(), r) for r in left if r[3] == s)
        budget = int(goal[s] + 1e-6)
        while budget > 0:
            for _, r in own:
                w = r[1].split()
                if take := min(len(w), budget):
                    out.append((r[0], tuple(w[:take])))
                budget -= take
    return sorted(out)


def covered(text, item, least=5):
    """Tokens of the item under greedy tiles, by comparing all places."""
    used_t, used_p, total = [False] * len(text), [False] * len(item), 0
    while True:
        best, at = min(least, len(item)) - 1, None
        for p in range(len(item)):
            for t in range(len(text)):
                n = 0
                while t + n < len(text) and p + n < len(item) and text[t + n] == item[p + n] and not used_t[t + n] and not used_p[p + n]:
                    n += 1
                if n > best:
                    best, at = n, (p, t)
        if at is None:
            return total
        p, t = at
        used_p[p : p + best], used_t[t : t + best] = [True] * best, [True] * best
        total += best


def test_pipeline_by_brute_force(spark, tmp_path):
    rng, rows = random.Random(23), []
    vocabulary = ["the", "of", "an", "is", "river", "stone", "lantern", "quiet", "mill", *[f"word{k}" for k in range(300)]]
    items = [" ".join(rng.choice(vocabulary) for _ in range(20)) for _ in range(4)]
    for k in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(30, 70))]
        if k % 7 == 3:
            words = rows[rng.randrange(len(rows))][1].split()
            if k % 2:
                words[rng.choice([0, -1])] = "edited"
        elif k % 11 == 5:
            words = words[:15] + items[k % 4].split() + words[15:]
        elif k % 13 == 6:
            words = [f"{w}###" for w in words]
        text = ", ".join(" ".join(words[a : a + 6]) for a in range(0, len(words), 6)) + "." if k % 7 != 3 else " ".join(words)
        rows.append((k * 5 + 2, text, "en", rng.choice(["a", "b", "c", "d"]), len(text)))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = slow_pipeline(spark, rows, items)
    assert sorted((r["doc_id"], tuple(r["text"].split())) for r in got) == want and 40 < len({i for i, _ in want}) < 140
    assert all(r["n_chars"] == len(r["text"]) and 0 <= r["shard"] < 24 for r in got)
    assert sorted((r["shard"], r["slot"]) for r in got) == [(s, k) for s in range(24) for k in range(sum(r["shard"] == s for r in got))]


def test_local_folders_are_for_one_machine():
    class Cluster:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return {}

        class conf:  # noqa: N801
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Cluster())


def test_vectors(spark):
    ship(spark)
    nan, inf = float("nan"), float("inf")
    vectors = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (3, [1.0, 0.0]), (11, [0.0, 1.0]), (12, [0.95, 0.31])]
    frame = spark.createDataFrame([(i, v, 0, 5) for i, v in vectors], "vec_id long, embedding array<float>, id int, m int")
    got = {(r["id"], r["n_links"], r["component"], r["kept"]) for r in embedding_lsh.near_vectors(frame).collect()}
    assert {(1, 4, 1, True), (2, 4, 1, False), (3, 4, 1, False), (11, 0, 11, True), (10, 0, 10, True), (6, 0, 6, True), (12, 4, 1, False)} <= got
    assert all(n == 0 for i, n, _, _ in got if i in (4, 5, 6, 7, 8, 9, None))
    assert embedding_lsh.near_vectors(frame.where("false")).collect() == []


def test_messages(spark):
    ship(spark)
    turns = spark.createDataFrame([(1, 0, "user", "hi", 1), (1, 1, "assistant", None, 1), (1, 1, "assistant", None, 1), (None, None, None, None, 1), (2, 5, "user", None, 1), (2, 0, "system", "", 1)], "conv_id long, turn long, role string, text string, slot int")
    got = chat.link(chat.exchanges(turns), chat.REPLY_TOOL).collect()
    assert len(got) == 5 and {r["status"] for r in got} == {"ok", "bad_json", "no_result,bad_json"}
    assert chat.link(chat.exchanges(turns.where("false")), chat.REPLY_TOOL).collect() == []


def test_slots_are_gapless(docs):
    got = sharding.shard(docs, sharding.uniform_tree(3)).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m"), F.countDistinct("slot").alias("d")).collect()
    assert all(r["n"] == r["m"] + 1 == r["d"] for r in got)


def test_dedup_of_nameless_and_repeated_rows(spark):
    ship(spark)
    same, other = "a b c d e f g h i j", "k l m n o p q r s t"
    rows = [(1, same), (2, same), (2, same), (None, same), (None, other), (None, other), (3, "u v w x y z"), (3, "u v w x y z"), (3, "1 2 3 4 5 6 7")]
    got = sorted(((r["doc_id"] or 0, r["text"]) for r in neartext.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got[:2] == [(0, other), (1, same)] and len(got) == 3 and got[2][0] == 3


def near(word, **changed):
    """Sixty words of their own; a changed one is in five of their shingles."""
    return " ".join(changed.get(f"{word}{k}", f"{word}{k}") for k in range(60))


def test_near_copies_without_ids(spark):
    ship(spark)
    rows = [(1, near("a")), (None, near("a", a30="x")), (None, near("b")), (None, near("b", b59="x")), (None, near("c"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = neartext.groups(docs).collect()
    assert sorted(r["component"] or 0 for r in found) == [0, 0, 0, 1, 1] and len({r["lead"] for r in found}) == 3
    got = [(r["doc_id"], r["text"][:1]) for r in neartext.deduplicated(docs).collect()]
    assert sorted(got, key=lambda r: r[1]) == [(1, "a"), (None, "b"), (None, "c")]


def test_texts_under_one_id(spark):
    ship(spark)
    rows = [(7, near("a")), (7, near("b")), (3, near("a", a30="x")), (9, near("b", b30="x")), (20, near("c")), (20, near("d")), (21, near("c", c30="x")), (22, near("d", d30="x"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["id"], r["t"]): (r["component"], r["lead"]) for r in neartext.groups(docs).collect()}
    hashed = {r["text"]: r["t"] for r in docs.select("text", F.xxhash64("text").alias("t")).collect()}
    assert [found[i, hashed[t]][0] for i, t in rows] == [3, 7, 3, 7, 20, 20, 20, 20] and len({x for _, x in found.values()}) == 4
    got = {(r["doc_id"], r["text"][0]) for r in neartext.deduplicated(docs).collect()}
    assert {(3, "a"), (7, "b")} < got and got - {(3, "a"), (7, "b")} in ({(20, "c"), (22, "d")}, {(20, "d"), (21, "c")})


def bit_differs(both, a, b):
    """The chance of a bit to differ between sets that share so many shingles and have a and b more: exact sums."""
    half = lambda n: [comb(n, k) / 2**n for k in range(n + 1)]
    over = lambda n, k, size: sum(half(n)[max(0, size // 2 + 1 - k) :])
    sums = ((x, over(a, k, both + a), over(b, k, both + b)) for k, x in enumerate(half(both)))
    return sum(x * (p * (1 - q) + q * (1 - p)) for x, p, q in sums)


def test_gate_of_pairs_at_the_threshold():
    beyond = lambda n, p, most: sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(most + 1, n + 1))
    for both in [*range(4, 45), 60, 80, 108]:
        more = both // 4
        for a in range(more // 2 + 1):
            p, kind = bit_differs(both, a, more - a), int(both + a >= neartext.SMALL)
            kinds = {kind, int(both + more - a >= neartext.SMALL)}
            assert all(beyond(128, p, neartext.FIRST[1 - (k == 0)]) + beyond(256, p, neartext.ALL[1 - (k == 0)]) < 3e-9 for k in kinds), (both, a)


def test_four_of_five_shingles(spark):
    ship(spark)
    rows = [(2 * k + m, " ".join(f"w{k}x{i}" for i in range(8 + m))) for k in range(2000) for m in (0, 1)]
    found = neartext.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["id"], r["component"]) for r in found} == {(i, i - i % 2) for i, _ in rows}
