"""Texts that the references must reject or leave alone."""

import random

import pytest

from tidemark.llm import quality_rules
from tidemark.llm.common import table


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, "/root/testdata/sf0.01", "documents")


def test_texts_without_common_words_are_rejected(spark, docs):
    rng = random.Random(3)
    salad = " ".join("".join(rng.choice("abcdeghilmnoprstu") for _ in range(rng.randint(3, 8))) for _ in range(400)).capitalize()
    refs = {r["lang"]: quality_rules.Reference(r["classes"], r["keys"], r["counts"], r["words"]) for r in quality_rules.references(docs).collect()}
    assert not {w for r in refs.values() for w in r.keys} & set(salad.lower().encode().split())
    usual = [(r["lang"], " ".join(w for line in r["text"].split("\n") for w in line.split())) for r in docs.where("length(text) > 3000").join(table(spark, "/root/testdata/sf0.01", "labels").where("quality = 1"), "doc_id").limit(40).collect()]
    got = quality_rules.rules(salad.encode(), refs["en"])
    assert not got[5] and got[6] <= quality_rules.MOST_CHARS and not got[8]
    assert not any(quality_rules.rules(salad.encode(), r)[8] for r in refs.values())
    assert len(refs) == 4 and sum(quality_rules.rules(t.encode(), refs[lang])[8] for lang, t in usual) >= 0.97 * len(usual)


def test_clean_texts_of_every_language_stay(spark, docs):
    got = quality_rules.op3_quality_rules(docs).join(docs.select("doc_id", "lang"), "doc_id").join(table(spark, "/root/testdata/sf0.01", "labels").where("quality = 1"), "doc_id").collect()
    for lang in {r["lang"] for r in got}:
        kept = [r["kept"] for r in got if r["lang"] == lang]
        assert sum(kept) >= 0.95 * len(kept), lang


def test_a_rare_language_in_another_script_stays(spark, docs):
    """A language with too few words for a reference is not judged by the others'; a text under a wrong language is."""
    words = "утром город просыпается рано люди спешат на работу мимо старого рынка где продают хлеб рыбу овощи цветы книги посуду".split()
    rng = random.Random(5)
    text = " ".join(rng.choice(words) for _ in range(120))
    rare = spark.createDataFrame([(-1, text, "ru"), (-2, text, "en")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in quality_rules.op3_quality_rules(docs.select("doc_id", "text", "lang").union(rare)).where("doc_id < 0").collect()}
    assert got[-1]["kept"] and got[-2]["char_distance"] > quality_rules.MOST_CHARS and not got[-2]["kept"]
