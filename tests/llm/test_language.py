import random

import numpy as np
import pytest
from samples import DATA

from pyspark.sql import functions as F

from beaconlake.llm.language import (
    fit_trigrams, identify_documents, identify_pages, keep_identified, letters, page_parts, posterior, trigrams,
)

SAMPLES = {
    "en": "the house and the river were there when they went with her to the other side of the garden",
    "de": "der Hund und die Katze sind nicht in dem Haus weil sie auf der Straße mit einem Ball spielen",
    "fr": "les enfants de la maison ont mangé une pomme avec leur mère dans le jardin près de la rivière",
}


def test_letters_and_trigrams():
    assert letters("A1b, ÄÖ  c!") == " a b ÄÖ c ".encode() and letters(None) == letters("12 .") == b""
    codes, ends = trigrams([b" ab ", b"", b" ab ", b" c "])
    assert ends.tolist() == [2, 2, 4, 5] and codes[:2].tolist() == codes[2:4].tolist()


def test_page_parts():
    page = '<!DOCTYPE html><html class="x" lang="fr-CA"><style>p{a}</style><!-- no --><p>a &amp; b</p><script>x<y</script>'
    text, *rest = page_parts(page, "https://user@Blog.Maison.fr:80/x?y")
    assert text.split() == ["a", "&", "b"] and rest == ["fr", "fr", "maison.fr", "blog.maison.fr"]
    assert page_parts(None, None) == (None,) * 5 and page_parts("<p>x", "no address")[1:] == (None,) * 4


def test_fusion_of_evidence():
    own, scores = np.full((1, 2), 0.5), np.zeros((1, 2))
    none = {k: np.full((1, 2), np.nan) for k in ("declared", "suffix", "domain", "host")}
    corpus = np.array([50.0, 50.0])

    def fused(scores=scores, declared=(0, 0), **sums):
        return posterior(own, scores, {**none, **{k: np.array([v]) for k, v in sums.items()}}, corpus, np.array([declared]))[0]

    assert np.allclose(fused(), 0.5)
    assert min(fused(**{level: [30.0, 1.0]})[0] for level in ("suffix", "domain", "host")) > 0.8
    # A host's own pages outweigh those of its domain.
    assert fused(domain=[100.0, 0.0], host=[0.5, 60.0])[1] > 0.5
    # Strong text evidence outweighs a prior.
    assert fused(scores=np.array([[0.0, 30.0]]), host=[40.0, 0.0])[1] > 0.99


@pytest.fixture(scope="module")
def languages(make_documents):
    rows = []
    for number, (name, text) in enumerate(SAMPLES.items()):
        words = text.split()
        for i in range(40):
            rows.append((number * 100 + i, " ".join(words[i % 7 :] + words[: i % 7]), name))
    return rows


def test_planted_languages(make_documents, languages):
    odd = [(900, "der Hund ist in dem Haus und die Katze auf der Straße", "en"), (901, "0101 ... 7788"), (902, None), (903, ""), (904, "zzxqj qqxzj jjqxz xqzjq zqxjj", None)]
    rows = make_documents(languages + odd)
    found = {r.doc_id: r for r in identify_documents(rows, ["doc_id"]).collect()}
    for doc_id, _, name in languages:
        assert found[doc_id].language == name and found[doc_id].accepted and found[doc_id].probability > 0.9
    assert found[900].language == "de" and found[900].declared == "en" and found[900].accepted
    assert not any(found[i].accepted for i in (901, 902, 903, 904))
    kept = keep_identified(rows)
    assert kept.columns == rows.columns and {r.doc_id for r in kept.collect()} == set(found) - {901, 902, 903, 904}


def test_pages(spark, make_documents, languages):
    pages = [(i, f"http://site{i % 3}.example.{i % 2 and 'de' or 'fr'}/{i}", f"<html lang=de><body>{SAMPLES['de'][i:]}</body>") for i in range(12)]
    pages += [(50, "http://site0.example.de/x", "<p>12</p>"), (51, None, None), (52, "nothing", ""), (53, "", "<html lang=en>")]
    table = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, host string")
    found = {r.page_id: r for r in identify_pages(table, make_documents(languages)).collect()}
    assert len(found) == len(pages)
    assert all(found[i].language == "de" and found[i].declared == "de" for i in range(12))
    assert found[50].language == "de" and not found[50].accepted  # host and suffix only
    assert not any(found[i].accepted for i in (51, 52, 53))


def test_odd_rows(odd_documents, no_documents):
    rows = identify_documents(odd_documents, ["doc_id"]).collect()
    assert len(rows) == odd_documents.count()
    assert not any(r.accepted for r in rows if r.doc_id in (1, 2, 3, 8, 10))
    assert identify_documents(no_documents, ["doc_id"]).collect() == []
    assert keep_identified(no_documents).collect() == []
    named = odd_documents.withColumn("__digest", F.lit("mine")).withColumn("__DIGEST_", F.lit("too"))
    kept = keep_identified(named)
    assert kept.columns == named.columns and {(r["__digest"], r["__DIGEST_"]) for r in kept.collect()} == {("mine", "too")}
    accepted = sorted(str(r.doc_id) for r in rows if r.accepted)
    assert sorted(str(r.doc_id) for r in kept.collect()) == accepted


def test_without_known_languages(make_documents):
    rows = identify_documents(make_documents([(1, "some text", None)]), ["doc_id"]).collect()
    assert [(r.doc_id, r.language, r.accepted) for r in rows] == [(1, None, False)]


def test_whole_tables(spark, documents, texts):
    found = identify_documents(documents, ["doc_id"]).collect()
    labels = {r.doc_id: r.lang for r in documents.select("doc_id", "lang").collect()}
    right = [r.language == labels[r.doc_id] for r in found]
    assert len(found) == len(texts) and np.mean(right) > 0.97 and np.mean([r.accepted for r in found]) > 0.97
    model = fit_trigrams(documents, rows=50)
    assert model.languages == sorted(set(labels.values()))
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    assert identify_pages(pages, documents).count() == pages.count()


def invented(rng):
    """Texts of one language: its words are made of letter pairs of its own."""
    pairs = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=2)) for _ in range(12)]
    return lambda: " ".join("".join(rng.choices(pairs, k=3)) for _ in range(40))


def test_more_than_64_languages(make_documents):
    rng, rows = random.Random(1), []
    for number in range(70):
        text = invented(rng)
        # The last names are the rarest.
        rows += [(len(rows) + i, text(), f"l{number:02d}") for i in range(5 if number >= 66 else 8)]
    table = make_documents(rows)
    assert len(fit_trigrams(table).languages) == 70
    found = {r.doc_id: r for r in identify_documents(table, ["doc_id"]).collect()}
    assert all(found[i].language == name for i, _, name in rows)


def test_a_rare_language_is_fitted(make_documents):
    rng = random.Random(2)
    frequent, rare = invented(rng), invented(rng)
    rows = [(i, frequent(), "aa") for i in range(3000)] + [(3000 + i, rare(), "bb") for i in range(3)]
    model = fit_trigrams(make_documents(rows), rows=20, least=10)
    assert np.ptp(model.logs[:, model.languages.index("bb")]) > 0  # not only smoothing
    same = fit_trigrams(make_documents([(i, "the same words", "cc") for i in range(50)]), rows=1, least=1)
    assert np.ptp(same.logs[:, 0]) > 0
