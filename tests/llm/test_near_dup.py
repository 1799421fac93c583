"""Near-dedup of the pipeline against brute-force Jaccard of 5-word shingles."""

import random

import corpus_pipeline
from tidemark.llm import near_dup
from tidemark.llm.common import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def brute_groups(texts):
    """id -> least id that links of Jaccard 0.8 or more lead to."""

    def grams(t):
        w = (t or "").lower().split()
        return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))

    sets, ids = {i: grams(t) for i, t in texts.items()}, sorted(texts)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def kept(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in texts.items()], SCHEMA).repartition(3)
    return {r["doc_id"] for r in corpus_pipeline.near_dup_stage(spark, docs, "").collect()}


def test_near_copies_are_found_and_others_stay(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "SAMPLE", 1)
    rng = random.Random(7)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    passage, texts = words(60), {}

    def add(w):
        texts[len(texts)] = " ".join(w)

    for n, changes in ((100, (1, 2, 3, 5)), (300, (2, 4, 6, 8, 12)), (1000, (10, 20, 22, 30))):
        for _ in range(6):
            base = words(n)
            add(base)
            for c in changes:
                w = list(base)
                for at in rng.sample(range(n), c):
                    w[at] = f"x{rng.randrange(10**9)}"
                add(w)
    base = words(200)  # a chain: each is near the next, the ends are not near
    for k in range(12):
        add(base[6 * k :] + [f"c{j}" for j in range(6 * k)])
    for _ in range(40):  # a passage that many texts share, half of each
        add(passage + words(60))
    exact = [f"e{k}" for k in range(24)]  # 16 shingles, all among the 20 of the next: exactly 0.8
    add(exact[:20])
    add(exact[:24])
    for t in ("", " \t\n", "one two", "ONE  two", "two one"):
        texts[len(texts)] = t
    texts[len(texts)] = None
    want = brute_groups(texts)
    assert len(set(want.values())) < 0.7 * len(want)
    assert kept(spark, texts) == set(want.values())


def test_near_copies_of_the_tables(spark):
    texts = {r["doc_id"]: r["text"] for r in table(spark, "/root/testdata/sf0.01", "documents").collect()}
    assert kept(spark, texts) == set(brute_groups(texts).values())


def test_prefixes_suffice():
    """Where common elements come last in both orders, as they may at worst, prefixes still share what candidates must."""
    for n in range(1, 300):
        for m in range(n, n * 5 // 4 + 1):
            for both in range(-(-4 * (n + m) // 9), n + 1):
                got = min(near_dup.prefix_length(n) - (n - both), near_dup.prefix_length(m) - (m - both))
                assert got >= min(near_dup.shared_least(n), -(-4 * m // 5))


def test_fingerprints_name_candidates(spark, monkeypatch):
    """Copies with a word changed are found by the fingerprints' range join alone, and checked: near prints of sets that are not near don't link."""
    monkeypatch.setattr(near_dup, "_candidates", lambda met: met.where("1 = 0").select("a", "b"))
    rng = random.Random(11)
    texts, copies = {}, 0
    for k in range(0, 80, 2):
        w = [f"w{rng.randrange(5000)}" for _ in range(1500)]
        texts[k] = " ".join(w)
        w[700] = "changed"
        texts[k + 1] = " ".join(w)
        sets = [near_dup.shingles(texts[j].encode(), near_dup.Remembered(near_dup._word_hash, 10_000)) for j in (k, k + 1)]
        copies += bin(near_dup.majority(sets[0]) ^ near_dup.majority(sets[1])).count("1") <= 2
    assert copies > 20
    assert len(kept(spark, texts)) <= len(texts) - copies
    profiles = spark.createDataFrame([(1, 0), (2, 3), (3, 0), (4, 15), (5, -1)], "class long, print long")
    edges = {(r["a"], r["b"]) for r in near_dup.by_fingerprints(profiles).collect()}
    assert edges == {(1, 2), (1, 3), (2, 4)}
