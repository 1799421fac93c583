"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import common, decontaminate, language_model, line_dedup, mixing, pii, quality_model, quality_rules, simhash, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = "one two three four five six seven eight nine ten eleven twelve"
LONG = " ".join(f"w{k % 977}" for k in range(40_000))
ROWS = [
    (1, "Alpha beta gamma delta.\nShared line of some length\n" + PASSAGE, "en", "a", 10),
    (2, "Shared line of some length\nother words here", "en", "a", 10),
    (2, "Shared line of some length\nother words here", "en", "a", 10),  # a repeated row
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, " \t\n ", "en", "b", 3),
    (None, "Shared line of some length", "de", None, 5),
    (None, None, None, "c", None),
    (6, LONG, "en", "a", len(LONG)),
    (7, "É😀 üß " + PASSAGE.upper() + " tail", "fr", "b", 3),
    (8, "idiot scum trash mail a@b.co 10.1.2.3", "en", "c", 3),
    (9, "x" * 200_000, "en", "c", 3),
]
LABELS = "doc_id long, quality int, toxic int"
MADE = [(k, 1 if k % 2 else 0, 1 if k % 3 == 0 else 0) for k in range(1, 9)] + [(None, 1, 1), (1, None, None), (1, 1, 0)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, DOCS)
    # names that the operators use inside
    return df.withColumn("mark", F.lit("m")).withColumn("size", F.lit(-1)).withColumn("print", F.lit(0)).withColumn("row", F.lit("r")).withColumn("kept", F.lit(1)).withColumn("id", F.lit(2)).withColumn("score", F.lit(3.0)).withColumn("held_out", F.lit(True)).withColumn("chunk", F.lit(5)).withColumn("n_words", F.lit(6)).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(MADE, LABELS)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (2, "üß one"), (3, None), (None, "tail"), (4, "")], "item_id long, text string")


def ops(docs, labels, items):
    return {
        1: lambda d: simhash.op1_simhash(d), 3: lambda d: quality_rules.op3_quality_rules(d), 4: lambda d: pii.op4_pii(d), 5: lambda d: mixing.op5_mix(d),
        6: lambda d: decontaminate.op6_decontaminate(d, items), 7: lambda d: line_dedup.op7_line_dedup(d), 8: lambda d: toxicity.op8_toxicity(d, labels),
        9: lambda d: quality_model.op9_quality_classifier(d, labels), 10: lambda d: language_model.op10_language_model(d),
    }


@pytest.mark.parametrize("n", [1, 3, 4, 5, 6, 7, 8, 9, 10])
def test_rows_come_back(docs, labels, items, n):
    rows = ops(docs, labels, items)[n](docs).collect()
    distinct = len({(r[0], r[1]) for r in ROWS})
    assert len(rows) == (distinct if n == 6 else len(ROWS))
    assert {r["doc_id"] for r in rows} == {r[0] for r in ROWS}


@pytest.mark.parametrize("n", [1, 3, 4, 5, 6, 7, 8, 9, 10])
def test_empty_table(docs, labels, items, n):
    assert ops(docs, labels, items)[n](docs.limit(0)).count() == 0


def test_empty_labels_and_items(docs, labels, items):
    none = labels.limit(0)
    assert {r["score"] for r in toxicity.op8_toxicity(docs, none).collect()} == {0.0}
    assert {r["score"] for r in quality_model.op9_quality_classifier(docs, none).collect()} == {0.0}
    assert not any(r["contaminated"] for r in decontaminate.op6_decontaminate(docs, items.limit(0)).collect())


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def test_simhash_values(docs):
    got = by_id(simhash.op1_simhash(docs))
    assert got[2][0]["fingerprint"] == got[2][1]["fingerprint"] and got[2][0]["component_id"] == 2
    assert got[3][0]["fingerprint"] == "0" * 16 and got[3][0]["component_id"] == 3
    assert got[4][0]["component_id"] == 3 and got[5][0]["component_id"] == 3
    assert {r["component_id"] for r in got[None]} <= {3, None}


def test_line_dedup_values(docs):
    got = by_id(line_dedup.op7_line_dedup(docs))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert [(r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in got[2]] == [(2, 1, sha("other words here"))] * 2
    assert (got[3][0]["n_lines"], got[3][0]["n_dropped"], got[3][0]["kept_sha256"]) == (1, 0, sha(""))
    assert got[1][0]["n_dropped"] == 0
    assert sorted(r["n_dropped"] for r in got[None]) == [0, 1]


def test_decontaminate_values(docs, items):
    got = by_id(decontaminate.op6_decontaminate(docs, items))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    r = got[1][0]
    assert (r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (12, 1, sha("1"), True)
    r = got[7][0]  # É stays É: only A-Z are lower-cased; the emoji is no ASCII mark, so it is a part of a word
    assert (r["n_hit"], r["n_items"], r["items_sha256"]) == (14, 2, sha("1,2"))
    assert got[6][0]["n_words"] == 40_000 and not got[6][0]["contaminated"]


def test_mix_values(docs):
    rows = mixing.op5_mix(docs).collect()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    full = mixing.mix(docs).collect()
    for source in {r["source"] for r in full}:
        part = [r for r in full if r["source"] == source]
        assert abs(sum(r["taken"] for r in part) - part[0]["target"]) <= 1
        assert sum(r["size"] for r in part) == part[0]["source_size"]
    assert sorted((str(r["doc_id"]), r["taken"]) for r in rows) == sorted((str(r["doc_id"]), r["taken"]) for r in mixing.op5_mix(docs.repartition(5)).collect())


def test_mix_takes_heavy_documents_first(spark):
    """A noisy document has a lower weight, so over many draws clean ones are taken more."""
    rows = [(k, "word " * 20 if k % 2 else "#*$ " * 20, "a") for k in range(2000)] + [(k, "word " * 20, "b") for k in range(2000, 2100)]
    got = mixing.op5_mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    extra = [r["taken"] - 20 * (r["target"] // r["source_size"]) for r in got]
    clean = sum(x for r, x in zip(got, extra) if r["doc_id"] % 2 and r["doc_id"] < 2000)
    noisy = sum(x for r, x in zip(got, extra) if r["doc_id"] % 2 == 0 and r["doc_id"] < 2000)
    assert clean > 2 * noisy


def test_pii_values(docs):
    r = by_id(pii.op4_pii(docs))[8][0]
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 0, 0)
    assert r["spans"].startswith("email:22:28,ip:29:37")


def test_near_copies_chain(spark):
    """Copies each a little off the one before end up in one component, whose rows never make pairs."""
    words = [f"v{k}" for k in range(400)]
    rows = []
    for k in range(60):
        w = list(words)
        w[5 * k] = "changed"
        rows.append((100 + k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    prints = {i: simhash.fingerprint(t.encode()) for i, t in rows}
    from tests.llm.test_brute_force import brute_components

    want = brute_components(prints)
    assert {r["doc_id"]: r["component_id"] for r in simhash.op1_simhash(df).collect()} == want


def test_components_of_a_long_path(spark):
    n = 300
    edges = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(1000, 1001)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {**{k: 0 for k in range(1, n + 1)}, 1001: 1000}


def test_hot_line_and_passage(spark):
    """A third of all rows share one line and one passage."""
    rows = [(k, ("the line that all of them share\n" if k % 3 == 0 else "") + f"own words of number {k} and more {k * 7}" + (" " + PASSAGE if k % 3 == 0 else "")) for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    dropped = {r["doc_id"]: r["n_dropped"] for r in line_dedup.op7_line_dedup(df).collect()}
    assert sum(dropped.values()) == 299 and dropped[0] == 0
    items = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    hits = {r["doc_id"]: r["n_hit"] for r in decontaminate.op6_decontaminate(df, items).collect()}
    assert hits == {k: 12 if k % 3 == 0 else 0 for k in range(900)}


def test_both_ways_beyond_the_broadcast_bound(spark, docs, items, monkeypatch):
    want = sorted(map(str, decontaminate.op6_decontaminate(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", 0)
    assert sorted(map(str, decontaminate.op6_decontaminate(docs, items).collect())) == want


def test_url_filter(spark):
    from datetime import date

    entries = spark.createDataFrame([("bad.org", date(2020, 1, 1), "add", "x"), ("BAD.org", date(2020, 6, 1), "remove", "x"), ("bad.org", date(2021, 1, 1), "add", "y"), ("bad.org", date(2021, 1, 1), "add", "z"), (None, date(2020, 1, 1), "add", "x"), ("a.bad.org", date(2020, 2, 1), "add", "w")], "host string, listed_on date, action string, category string")
    rows = [
        (1, "http://a.bad.org/p", date(2020, 1, 15)), (2, "https://user@A.BAD.ORG:8080?x", date(2020, 3, 1)), (3, "http://bad.org", date(2020, 6, 1)), (4, "http://bad.org./", date(2023, 5, 5)),
        (5, "http://notbad.org", date(2023, 5, 5)), (6, None, date(2023, 5, 5)), (7, "not a url", date(2023, 5, 5)), (8, "http://bad.org", None), (None, "http://bad.org", date(2019, 1, 1)), (4, "http://bad.org./", date(2023, 5, 5)),
    ]
    got = {r["page_id"]: r for r in url_filter.blocked_as_of(spark.createDataFrame(rows, "page_id long, url string, fetched_on date"), entries).collect()}
    assert {k: r["matched"] for k, r in got.items()} == {1: "bad.org", 2: "a.bad.org", 3: None, 4: "bad.org", 5: None, 6: None, 7: None, 8: None, None: None}
    assert got[4]["category"] == "y" and not got[3]["blocked"]
    assert url_filter.blocked_as_of(spark.createDataFrame([], "page_id long, url string, fetched_on date"), entries).count() == 0


def test_pipeline_stages(spark, docs, tmp_path):
    """Each stage takes odd rows, returns the columns of documents, and acts on what it decides."""
    from tidemark.llm.common import table

    sf = "/root/testdata/sf0.001"
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == columns and out.dtypes == docs.dtypes, name
        out.collect()
        assert stage(spark, docs.limit(0), sf).count() == 0
    lines = by_id(corpus_pipeline.line_stage(spark, docs, sf))
    assert lines[2][0]["text"] == "other words here" and lines[2][0]["n_chars"] == 16 and lines[3][0]["text"] is None
    one = corpus_pipeline.near_dup_stage(spark, docs, sf).collect()
    assert sum(r["doc_id"] == 2 for r in one) == 1 and sum(r["doc_id"] in (3, 4, 5) for r in one) == 1
    real = table(spark, sf, "documents")
    clean = corpus_pipeline.decontaminate_stage(spark, real, sf)
    bad = {r["doc_id"] for r in decontaminate.op6_decontaminate(real, table(spark, sf, "benchmark")).where("contaminated").collect()}
    assert bad and {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in real.collect()} - bad


def test_pipeline_against_its_parts(spark):
    """run() equals the operators put together by hand, with joins in plain Python."""
    from tidemark.llm.common import table

    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r for r in table(spark, sf, "documents").collect()}
    scored = quality_model.op9_quality_classifier(table(spark, sf, "documents"), table(spark, sf, "labels")).collect()
    left = {r["doc_id"]: docs[r["doc_id"]].asDict() for r in scored if r["predicted"]}
    keep = {}
    for i in sorted(left):
        for line in left[i]["text"].split("\n"):
            key = line.strip(" \t\n\x0b\x0c\r")
            key = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in key)
            if len(key) >= 10:
                keep.setdefault(key, i)
    for i, r in left.items():
        lines = []
        for line in r["text"].split("\n"):
            key = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
            if len(key) < 10 or keep[key] == i:
                lines.append(line)
        r["text"] = "\n".join(lines)
    from tests.llm.test_near_dup import brute_groups

    roots = brute_groups({i: r["text"] for i, r in left.items()})
    left = {i: r for i, r in left.items() if roots[i] == i}
    as_table = spark.createDataFrame([(i, r["text"], r["lang"], r["source"], r["n_chars"]) for i, r in left.items()], DOCS)
    hits = {r["doc_id"] for r in decontaminate.op6_decontaminate(as_table, table(spark, sf, "benchmark")).where("contaminated").collect()}
    want = mixing.op5_mix(as_table.where(~F.col("doc_id").isin([-1, *hits])))
    got = corpus_pipeline.run(spark, sf)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {i: r["text"] for i, r in left.items() if i not in hits}
    assert got.columns[: len(DOCS.split(", "))] == [c.split()[0] for c in DOCS.split(", ")]


CLASHING = ["k", "m", "mark", "row", "text2", "class", "was_null", "size", "h", "d", "a.b", "i", "n"]


def test_pipeline_stages_pass_columns_of_any_name(spark, docs):
    sf = "/root/testdata/sf0.001"
    wide = docs.select("*", *[F.col("doc_id").cast("string").alias(c) for c in CLASHING if c not in docs.columns])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, sf)
        assert out.columns == wide.columns, name
        assert all(r["k"] == (None if r["doc_id"] is None else str(r["doc_id"])) == r["a.b"] for r in out.collect()), name
    mixed = corpus_pipeline.mix_stage(spark, wide, sf)
    assert mixed.count() == docs.count() and "k" in mixed.columns and mixed.columns.count("size") == 1


def test_url_filter_keeps_repeated_captures_and_odd_names(spark):
    """Repeats each get a row; hosts under one suffix, long urls and clashing names do no harm."""
    import datetime as dt

    day = dt.date(2022, 12, 5)
    rows = [(1, "https://a.example.net/x", day)] * 50 + [(k, f"http://h{k}.com/", day) for k in range(2, 40)] + [(50, "http://b.example.net/" + "y" * 300_000, day), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, fetched_on date").withColumn("host", F.lit("z")).withColumn("mark", F.lit(1)).withColumn("h", F.lit(2))
    entries = spark.createDataFrame(url_filter.LIST, "host string, listed_on string, action string, category string").withColumn("listed_on", F.to_date("listed_on"))
    got = {}
    for r in url_filter.blocked_as_of(pages, entries).collect():
        got.setdefault(r["page_id"], []).append(r)
    assert len(got[1]) == 50 and all(r["blocked"] and r["matched"] == "example.net" for r in got[1])
    assert got[50][0]["blocked"] and not any(got[k][0]["blocked"] for k in range(2, 40)) and got[None][0]["host"] is None


def test_pii_of_many_matches_stays_fast(spark):
    """Work is n log n in the matches of a text: price lists, and long lists of real spans of which loose ones touch some."""
    import time

    prices = ", ".join(str(10 + k % 90) for k in range(32_000))
    ips = " ".join(f"10.{k % 250}.1.{k % 200}" for k in range(8_000))
    mixed = " ".join(f"secret: abcdefgh{k}xyz a{k}@b.com" for k in range(4_000))
    docs = spark.createDataFrame([(1, prices), (2, ips), (3, mixed)], "doc_id long, text string")
    pii.op4_pii(docs.limit(0)).collect()
    began = time.perf_counter()
    got = by_id(pii.op4_pii(docs))
    assert time.perf_counter() - began < 25
    assert got[2][0]["n_ip"] == 8_000 and got[3][0]["n_email"] == 4_000 and got[1][0]["n_card"] == 0


PLANTED = {
    "email": ["Ann.Lee+x@mail.example.com", "bob_99@post.co.uk"],
    "ip": ["192.168.10.44", "8.8.4.4"],
    "card": ["4111 1111 1111 1111", "5500-0000-0000-0004"],
    "phone": ["+1 (555) 010-4477", "+44 20 7946 0958"],
    "hidden_email": ["ann.lee (at) example (dot) com", "bob[at]mail[dot]org"],
    "local_phone": ["(555) 234-5678", "415-555-2671"],
    "id_number": ["219-09-9999", "457-55-5462"],
    "secret": ["api_key = sk9f8a7d6c5b4e3f2a1b0c", "password: hunter2hunter2xyz77"],
}
DECOYS = ["version 1.2.3 of 2019-11-12", "pages 100-200", "order 4111 1111 1111 1112", "meet at noon", "chapter 12.4", "secret gardens are lovely", "1999-2004", "call me at home"]


def test_pii_finds_planted_spans_of_every_kind(spark):
    """Recall and precision by kind over planted spans among decoys."""
    rows, want = [], {}
    for k in range(400):
        kind = pii.KINDS[k % 8]
        value = PLANTED[kind][k // 8 % 2]
        lead = f"Words before {DECOYS[k % len(DECOYS)]}; " + ("my contact: " if k % 3 else "it is ")
        rows.append((k, f"{lead}{value} and words after."))
        want[k] = f"{kind}:{len(lead)}:{len(lead) + len(value)}"
    got = {r["doc_id"]: r["spans"].split(",") for r in pii.op4_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for kind in pii.KINDS:
        ids = [k for k in want if want[k].startswith(kind + ":")]
        assert sum(want[k] in got[k] for k in ids) >= 0.9 * len(ids), (kind, got[ids[0]], want[ids[0]])
    spans = sum(len([x for x in s if x]) for s in got.values())
    assert sum(want[k] in got[k] for k in want) >= 0.9 * spans


def test_quality_rules_do_not_turn_on_a_languages_share(spark):
    import random

    rng = random.Random(3)
    words = {lang: [f"{lang}{rng.randrange(10**6)}" for _ in range(300)] for lang in ("en", "sv")}
    text = lambda lang: " ".join(words[lang][min(int(rng.expovariate(0.03)), 299)] for _ in range(150))
    rows = [(k, text("en"), "en") for k in range(600)]
    sv = [(1000 + k, text("sv"), "sv") for k in range(40)]
    verdicts = []
    for some in (sv[:5], sv):
        got = {r["doc_id"]: r["kept"] for r in quality_rules.op3_quality_rules(spark.createDataFrame(rows + some, "doc_id long, text string, lang string")).collect()}
        verdicts.append([got[i] for i, _, _ in sv[:5]])
        assert sum(got[k] for k in range(600)) >= 595
    assert verdicts[0] == verdicts[1] == [True] * 5


def test_quality_rules_with_more_references_than_are_sent(spark, docs, monkeypatch):
    from tidemark.llm.common import table

    real = table(spark, "/root/testdata/sf0.01", "documents")
    want = sorted(map(str, quality_rules.op3_quality_rules(real).collect()))
    monkeypatch.setattr(quality_rules, "MOST_REFERENCES", 1)
    assert sorted(map(str, quality_rules.op3_quality_rules(real).collect())) == want


def test_cut_writes_to_the_shared_folder_and_forgets(spark, tmp_path, monkeypatch):
    from tidemark.sources import files

    monkeypatch.setattr(files, "_own_folder", [f"file://{tmp_path}"])
    monkeypatch.setattr(common, "_written", [])
    folder = common.shared_folder(spark)
    assert folder == (spark.conf.get("spark.checkpoint.dir", None) or f"file://{tmp_path}").rstrip("/")
    assert sorted(r["id"] for r in common.cut(spark.range(3), "x").collect()) == [0, 1, 2]
    (path,) = common._written
    assert path.startswith(folder)
    common.forget(spark)
    assert not common._written
