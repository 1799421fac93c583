"""Operators that SQL can't express, against plain Python over whole tables."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
import xxhash

from tidemark.llm import language_model, pii, quality_model, quality_rules, simhash, toxicity
from tidemark.llm.common import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_simhash(docs, texts):
    prints = {i: brute_print(t) for i, t in texts.items()}
    parts = brute_components(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op1_simhash(docs).collect()}
    assert got == {i: (f"{prints[i]:016x}", parts[i]) for i in texts}
    assert len(set(parts.values())) < len(parts)


def test_quality_rules(docs, texts):
    got = {r["doc_id"]: r for r in quality_rules.op3_quality_rules(docs).collect()}
    for i, t in texts.items():
        words = re.findall("[^\x20\x09-\x0d]+", t)
        n = len(words)
        windows = defaultdict(list)
        for k in range(n - 4):
            windows[tuple(words[k : k + 5])].append(k)
        repeat = len({k + j for at in windows.values() if len(at) > 1 for k in at for j in range(5)})
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        failed = n < 10 or 100 * repeat > 20 * n
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (
            n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeat, failed), i
        assert not (failed and r["kept"])


def test_quality_rules_keep_clean_documents(spark, docs):
    got = quality_rules.op3_quality_rules(docs).join(table(spark, SF, "labels"), "doc_id").collect()
    good = [r["kept"] for r in got if r["quality"] == 1]
    bad = [r["kept"] for r in got if r["quality"] == 0]
    assert sum(good) >= 0.97 * len(good)
    assert sum(bad) <= 0.6 * len(bad)


def luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(t):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


ODD = [
    "a@b.c_d@e.fg x@y a@b@c.d .@d.e é@x.yz q+w@m-n.o.p.", "1.2.3.4.5.6.7.8 256.1.1.1 00000000000255.0.0.0 1.2.3 999999999999999999999.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 411111111111111 4111111111111111" * 2, "+1 (499) 555-6503 +12 ++49 30 123456 +1.....2 +99999999999999999",
    "é😀 +33 1 23 45 67 89 é😀 a@b.co 10.0.0.1", "a." * 30_000 + "@b.c" + ".d" * 30_000, "1" * 50_000, "+" + "1 " * 20_000, "", None,
    "token = \"1eb9c654e721b4f812088970e66a6345cee33dd6\" ssn 123-45-6789 call 415-555-2671 or jane (at) example (dot) com",
]


def test_pii_base_spans(spark, docs, texts):
    odd = spark.createDataFrame([(10_000_000 + k, t) for k, t in enumerate(ODD)], "doc_id long, text string")
    all_texts = texts | {10_000_000 + k: t or "" for k, t in enumerate(ODD)}
    got = {r["doc_id"]: r for r in pii.op4_pii(docs.select("doc_id", "text").union(odd)).collect()}
    assert len(got) == len(all_texts)
    for i, t in all_texts.items():
        spans = brute_spans(t)
        r = got[i]
        said = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s[1] == k for s in spans) for k in range(4)], (i, t[:80])
        assert r["base_sha256"] == hashlib.sha256(",".join(said).encode()).hexdigest(), (i, t[:80])
        assert set(said) <= set(r["spans"].split(","))
    more = got[10_000_000 + len(ODD) - 1]["spans"]
    assert "secret:" in more


def crc(i):
    import zlib

    return zlib.crc32(str(i).encode())


def auc(pairs):
    pairs = sorted(pairs)
    ranks, k = {}, 0
    scores = [s for s, _ in pairs]
    for v, n in sorted(Counter(scores).items()):
        ranks[v] = k + (n + 1) / 2
        k += n
    pos = [ranks[s] for s, y in pairs if y]
    return (sum(pos) - len(pos) * (len(pos) + 1) / 2) / (len(pos) * (len(pairs) - len(pos)))


def test_quality_classifier_holds_out(spark, docs):
    labels = table(spark, SF, "labels")
    got = quality_model.op9_quality_classifier(docs, labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (crc(r["doc_id"]) % 4 == 2) for r in got)
    test = [(r["score"], r["quality"]) for r in got if r["held_out"]]
    assert auc(test) > 0.9
    assert sum((s >= 0.7) == bool(y) for s, y in test) > 0.85 * len(test)


def test_quality_score_by_plain_loops(spark, docs):
    """The pooled vector, the network and the temperature, written out with loops over words and units."""
    import math

    from tidemark.llm.sampling import labelled_sample

    m = quality_model.Model(*labelled_sample(docs, table(spark, SF, "labels"), "quality", per_class=60))
    (w1, b1, w2, b2), checked = m.net, 0
    texts = ["", "one", "the the the and", "A word, another word; 12 44 \u00e9t\u00e9 ###"] + [r["text"] or "" for r in docs.orderBy("doc_id").limit(15).collect()]
    for text in texts:
        words, pooled = text.encode().split(), [0.0] * quality_model.DIM
        for k, w in enumerate(words):
            if k and words[k - 1] == w:
                at = m.shapes[b"\x02same"]
            elif w in m.ids:
                at = m.ids[w]
            else:
                at = m.shapes.get(quality_model.shape(w), m.shapes[b"\x02other"])
            for d in range(quality_model.DIM):
                pooled[d] += float(m.vectors[at][d]) / len(words)
        extra = [sum(float(quality_model.index_vector(p)[d]) for p in quality_model.profile(words)) for d in range(quality_model.DIM)]
        x = [(v - float(mu)) / float(sd) for v, mu, sd in zip(pooled + extra, m.mean, m.scale, strict=True)]
        hidden = [math.tanh(sum(v * float(w1[i, j]) for i, v in enumerate(x)) + float(b1[j])) for j in range(w1.shape[1])]
        logit = sum(h * float(w) for h, w in zip(hidden, w2, strict=True)) + float(b2[0])
        assert m.scores([text.encode()])[0] == pytest.approx(1 / (1 + math.exp(-logit / m.temperature)), abs=1e-4)
        checked += 1
    assert checked == len(texts)


@pytest.mark.parametrize("folder", [SF, "/root/testdata/sf0.1"])
def test_toxicity_holds_out(spark, folder):
    """Recall over held-out rows of all languages, and of each with ten toxic ones or more; clean rows stay."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    got = toxicity.op8_toxicity(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    caught = Counter((r["lang"], r["predicted"]) for r in got if r["toxic"])
    assert sum(n for (_, p), n in caught.items() if p) >= 0.9 * sum(caught.values())
    for lang in {x for x, _ in caught}:
        n = caught[lang, 1] + caught[lang, 0]
        assert n < 10 or caught[lang, 1] >= 0.9 * n, lang
    clean = [r["predicted"] for r in got if not r["toxic"]]
    assert sum(clean) <= 0.02 * len(clean)


def test_toxic_score_by_enumeration(spark, docs):
    """A document's score from marginals that sum over all taggings of its words."""
    import itertools
    import math

    from tidemark.llm.sampling import labelled_sample

    m = toxicity.Tagger(*labelled_sample(docs, table(spark, SF, "labels"), "toxic", max_chars=3000))
    for text in ("you idiot", "the cat sat on a mat", "scum, trash! of the of", "Moron clown the it loser"):
        words = [toxicity.core(w) for w in text.encode().split()]
        emit, total, hot = [m.emission(w) for w in words], 0.0, [0.0] * len(words)
        for tags in itertools.product((0, 1), repeat=len(words)):
            log = float(m.start[tags[0]]) + sum(e for e, t in zip(emit, tags, strict=True) if t) + sum(float(m.trans[x, y]) for x, y in itertools.pairwise(tags))
            total += math.exp(log)
            for k, t in enumerate(tags):
                hot[k] += t * math.exp(log)
        p = [h / total for h in hot]
        mass = sum(p)
        z = float(m.c[0]) + float(m.c[1]) * math.log1p(mass) + float(m.c[2]) * max(p) + float(m.c[3]) * math.log1p(1000 * mass / (len(p) + 20))
        assert m.scores([text.encode()])[0][0] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6)


@pytest.mark.parametrize("name", ["op2_url_filter", "op5_mix", "op6_decontaminate", "op7_line_dedup"])
def test_sql_of_the_same_rows(spark, name):
    import duckdb

    from tidemark.llm import queries
    from tests.test_queries import plain

    folder, duck = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in got.description]
    df = queries.queries()[name](spark, folder)
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = Counter(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in order) for r in got.fetchall())
    assert Counter(tuple(plain(r[c]) for c in order) for r in df.collect()) == want


def test_labels_do_not_leak(spark, docs):
    """Labels of held-out rows change nothing."""
    labels = table(spark, SF, "labels")
    flipped = labels.withColumn("quality", __import__("pyspark").sql.functions.expr("if(crc32(cast(doc_id as string)) % 4 = 2, 1 - quality, quality)"))
    a = {r["doc_id"]: r["score"] for r in quality_model.op9_quality_classifier(docs, labels).collect()}
    b = {r["doc_id"]: r["score"] for r in quality_model.op9_quality_classifier(docs, flipped).collect()}
    assert a == b


def test_language_model(docs, texts):
    import math

    got = {r["doc_id"]: r for r in language_model.op10_language_model(docs).collect()}
    tokens = {i: [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t).encode().split()] + [b""] for i, t in texts.items()}
    counts = Counter(w for i, ws in tokens.items() if crc(i) % 10 for w in ws)
    n, v = sum(counts.values()), len(counts)
    gain = []
    for i, ws in tokens.items():
        r = got[i]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (crc(i) % 10 == 0, len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["open_score"] <= r["score"] < 0
        if r["held_out"]:
            gain.append((r["score"], base, len(ws)))
    assert sum(s for s, _, _ in gain) > sum(b for _, b, _ in gain)


def test_language_model_adds_up(spark):
    """Probabilities of all known words and of all else add up to one, after each class and after each word with a restaurant."""
    import numpy as np

    words = [b"", b"a", b"b", b"ab", b"abc", b"zz"]
    n = [(5, 1, 0, 0), (20, 3, 2, 0), (4, 0, 0, 9), (1, 0, 0, 0), (60, 7, 1, 1), (2, 0, 0, 0)]
    cells = {b"a": ([0, 1], [3, 1]), b"ab": ([1], [7])}  # after two words with restaurants of their own, of classes 3 and 2
    made = [(bytearray(w), *c, *cells.get(w, ([], []))) for w, c in [*zip(words, n), (b"new", (0, 0, 0, 0))]]
    schema = "word binary, n0 long, n1 long, n2 long, n3 long, ctx array<int>, times array<bigint>"
    model, totals = language_model.train(spark.createDataFrame(made, schema).repartition(2), np.array([3, 2]))
    rows = {bytes(r["word"]): r for r in model.collect()}
    assert set(rows) == {*words, b"new"} and rows[b"new"]["n"] == 0
    total = sum(10 ** np.array([r["lp01"], r["lp23"]], "<i8").view("<f4").astype(float) for r in rows.values())
    assert np.allclose(total, 1, atol=1e-5)
    back = (language_model.T2 + language_model.D2 * totals["t"]) / (language_model.T2 + totals["n"])
    for ctx, kind in ((0, 3), (1, 2)):
        mass = 0.0
        for r in rows.values():
            seen = {c >> 32: float(np.array([c & 0xFFFFFFFF], "<u4").view("<f4")[0]) for c in r["cells"]}
            rest = float(np.array([r["lp01"], r["lp23"]], "<i8").view("<f4")[kind])
            mass += 10 ** seen[ctx] if ctx in seen else back[ctx] * 10**rest
        assert mass == pytest.approx(1, abs=1e-5)
    assert rows[b"new"]["spell"] < 0 and rows[b"a"]["spell"] == 0


def test_byte_model_adds_up():
    """Byte sequences of a small length: the model's mass of all words up to it stays under one and near it."""
    import numpy as np

    words = [b"ab", b"ba", b"a", b"b", b"abab"]
    codes, _ = language_model.byte_cells(words)
    seen, n = np.unique(codes, return_counts=True)
    often = seen // 258 != seen[0] // 258
    low, at = np.unique(seen[~often] % 258**3, return_inverse=True)
    m = language_model.ByteModel(seen[often], n[often], low, np.bincount(at, n[~often]).astype(np.int64))
    for one, two, three in ((257, 257, 257), (257, 257, 97), (257, 97, 98), (1, 2, 3)):
        p = m.prob(((one * 258 + two) * 258 + three) * 258 + np.arange(257))
        assert p.sum() == pytest.approx(1, abs=1e-6)


def test_tables_by_enumeration():
    """Reseated tables against all seatings of a dish's customers, each weighed by the restaurant's odds."""
    import itertools
    import math

    import numpy as np

    d, strength, others, parent, n = 0.6, 3.0, 7.0, 0.05, 6
    weights = Counter()
    for seats in itertools.product(range(n), repeat=n):  # the table each customer picks; a new one is the next number
        if seats[0] or any(s > max(seats[:k]) + 1 for k, s in enumerate(seats) if k):
            continue
        sizes, w = Counter(), 1.0
        for s in seats:
            w *= (sizes[s] - d) if sizes[s] else (strength + d * (others + len(sizes))) * parent
            sizes[s] += 1
        weights[len(sizes)] += w
    want = sum(t * w for t, w in weights.items()) / sum(weights.values())
    many = 40_000
    for dd in (d,):
        language_model.TABLES.setdefault(dd, language_model.stirling(dd))
    t = language_model.reseat(np.full(many, n), np.full(many, others), strength, d, np.full(many, parent), np.arange(many, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 5)
    assert t.mean() == pytest.approx(want, abs=0.02)
    share = Counter(t.astype(int).tolist())
    assert all(abs(share[k] / many - w / sum(weights.values())) < 0.01 for k, w in weights.items())
    assert math.isfinite(want)


def test_marginals_by_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    lens = [1, 4, 7, 2]
    emit, first = rng.normal(size=sum(lens)) * 2, np.zeros(sum(lens), bool)
    first[np.cumsum([0, *lens[:-1]])] = True
    trans, start = rng.normal(size=(2, 2)), rng.normal(size=2)
    got, _ = toxicity.marginals(emit, first, trans, start)
    at, want = 0, []
    for n in lens:
        p, z = np.zeros(n), 0.0
        for tags in itertools.product((0, 1), repeat=n):
            s = start[tags[0]] + sum(emit[at + k] * tags[k] for k in range(n)) + sum(trans[tags[k - 1], tags[k]] for k in range(1, n))
            p += np.exp(s) * np.array(tags)
            z += np.exp(s)
        want += (p / z).tolist()
        at += n
    assert np.allclose(got, want)


def test_long_scan():
    import numpy as np

    rng = np.random.default_rng(5)
    emit = rng.normal(size=5000) * 3
    first = rng.random(5000) < 0.002
    first[0] = True
    trans, start = rng.normal(size=(2, 2)), rng.normal(size=2)
    got, _ = toxicity.marginals(emit, first, trans, start)
    cuts = [*np.flatnonzero(first).tolist(), 5000]
    for a, b in zip(cuts[:-1], cuts[1:]):
        f = np.zeros(b - a, bool)
        f[0] = True
        alpha = np.exp(start) * np.array([1, np.exp(emit[a])])
        fs = [alpha / alpha.sum()]
        for k in range(a + 1, b):
            x = (fs[-1] @ np.exp(trans)) * np.array([1, np.exp(emit[k])])
            fs.append(x / x.sum())
        beta, ps = np.ones(2), []
        for k in range(b - 1, a - 1, -1):
            x = fs[k - a] * beta
            ps.append((x / x.sum())[1])
            beta = np.exp(trans) @ (np.array([1, np.exp(emit[k])]) * beta)
            beta /= beta.sum()
        assert np.allclose(got[a:b], ps[::-1], atol=1e-6)
