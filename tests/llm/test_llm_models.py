"""Toxicity, languages and URLs: held-out accuracy, fixed cases and odd rows."""

import zlib

import corpus as C
import numpy as np
import pytest
from pyspark.sql import functions as F

from epistrand.llm import languages, queries, toxicity, urls
from epistrand.llm.words import LETTERS, Words

SF = "/root/testdata/sf0.01"


def test_toxicity_held_out(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = queries.op2_toxicity(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    tested = [(labels[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in labels]
    caught = sum(p for y, p in tested if y) / sum(y for y, _ in tested)
    wrong = sum(p for y, p in tested if not y) / sum(not y for y, _ in tested)
    assert caught >= 0.6 and wrong <= 0.03


def test_toxicity_does_not_see_held_out_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    other = labels.withColumn("toxic", F.when(toxicity.learnable(F.col("doc_id")), F.col("toxic")).otherwise(1 - F.col("toxic")))
    same = lambda x: {r.doc_id: r.score for r in toxicity.classify(docs, x).collect()}
    assert same(labels) == pytest.approx(same(other))


def test_word_counts_and_ratios(spark):
    rows = [("Bad bad day", 1, 0), ("good day. Good", 0, 0), ("bad", 1, 1), (None, 0, 1), ("", 1, 1)]
    counts = toxicity.count_words(spark.createDataFrame(rows, "text string, toxic int, part int"))
    found = sorted((r.t0, r.o0, r.t1, r.o1) for r in counts.collect())
    assert found == [(0, 2, 0, 0), (1, 1, 0, 0), (2, 0, 1, 0)]
    # Toxic: bad 3, day 1. Ordinary: good 2, day 1. The discount of 1 leaves bad 2 of 4 and
    # good 1 of 3; two of 4 and two of 3 are spread by the number of classes: 1, 2 and 1 of 4.
    ratios, other = toxicity.log_ratios(counts, F.col("t0") + F.col("t1"), F.col("o0") + F.col("o1"))
    mixed = lambda t, o: F.log(F.lit(0.95 + 0.05 * t / o))
    want = spark.range(1).select(mixed(2 / 4 + 2 / 4 / 4, 2 / 3 / 4), mixed(2 / 4 / 4, 1 / 3 + 2 / 3 / 4), mixed(2 / 4, 2 / 3)).first()
    assert sorted(r.ratio for r in ratios.collect()) == pytest.approx(sorted(want[:2]))
    assert other == pytest.approx(want[2])


def test_words_keep_their_own_ratios(spark):
    """Words whose hashes agree modulo 4194301 have nothing to do with each other."""
    names = [f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(17_576)]
    places, pair = {}, None
    for name, place in zip(names, (Words([" ".join(names).encode()], LETTERS).hashes % np.uint64(4194301)).tolist()):
        pair = pair or (place in places and (places[place], name)) or None
        places[place] = name
    bad, good = pair
    docs = spark.createDataFrame([(i, f"{bad if i % 2 else good} " * 5) for i in range(80)], "doc_id long, text string")
    model = toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")))
    rows = spark.createDataFrame([(1, f"{bad} " * 9), (2, f"{good} " * 9)], "doc_id long, text string")
    assert [r.predicted for r in model.score(rows).orderBy("doc_id").collect()] == [1, 0]


def test_toxicity_scores_do_not_depend_on_the_join(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(None, None), (None, ""), (-5, "qzx")], "doc_id long, text string"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = []
    for most in (toxicity.MOST_WORDS, 0):
        monkeypatch.setattr(toxicity, "MOST_WORDS", most)
        model = toxicity.fit(docs, labels)
        assert (model.table is None) == (most == 0)
        found.append(sorted(map(tuple, model.score(docs, keep_text=True).collect()), key=str))
    assert found[0] == found[1] and len(found[0]) == docs.count()


def test_toxicity_odd_rows(spark):
    docs = C.documents(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.classify(docs, none).collect()
    assert len(got) == docs.count() and all(r.score == pytest.approx(0.5) and r.predicted == 1 for r in got)
    labels = spark.createDataFrame([(1, 0), (1, 1), (4, None), (7, 5), (None, 1), (10, 0), (13, 0), (19, 0)], "doc_id long, toxic int")
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    rows = spark.createDataFrame([(None, None), (3, ""), (3, "")], "doc_id long, text string")
    got = toxicity.classify(rows, labels).collect()
    assert len({r.score for r in got}) == 1 and [r.held_out for r in got if r.doc_id is None] == [False]
    assert toxicity.classify(C.empty(spark), labels).count() == 0


def test_languages_held_out(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op3_language_id(spark, SF).collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    tested = [r for r in got if r.held_out]
    assert sum(docs[r.doc_id].lang == r.lang_pred for r in tested) >= 0.98 * len(tested)


def test_language_mixture(spark):
    """Halves of two languages are found as a mixture; one language as itself."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = languages.fit(docs.select("doc_id", "text", "lang"))
    text = {l: docs.filter(f"lang = '{l}' and n_chars > 2000").first().text[:2000] for l in ("en", "de")}
    rows = [(1, text["en"]), (2, text["de"]), (3, text["en"] + " " + text["de"][:1000])]
    got = {r.doc_id: (r.lang_pred, r.score) for r in model.predict(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1][0] == "en" and got[1][1] > 0.95 and got[2][0] == "de" and got[2][1] > 0.95
    assert got[3][0] == "en" and 0.5 < got[3][1] < 0.8


def test_languages_odd_rows(spark):
    docs = C.documents(spark)
    got = {r.doc_id: r for r in languages.identify(docs).collect()}
    for r in docs.collect():
        lettered = any(c.isalpha() for c in r.text or "")
        assert (got[r.doc_id].lang_pred == "und") == (not lettered), r.text
        assert 0 <= got[r.doc_id].score <= 1
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in languages.identify(unlabelled).collect()} == {"und"}
    assert languages.identify(C.empty(spark)).count() == 0
    i = next(i for i in range(9) if zlib.crc32(str(i).encode()) % 3 != 1)
    rows = [(None, "some words", "en"), (i, "some words", "en"), (i, "some words", "en"), (i, None, None)]
    one = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r.lang_pred for r in languages.identify(one).collect()) == ["en", "en", "en", "und"]


URLS = [
    None, "", "no scheme", "://", "http://", "https://Sub.Example.COM/en/x?y#z", "https://www.example.com/en/1",
    "https://a.www.example.com/en/", "http://example.com/EN/1", "http://com/", "http://xcom/", "http://n.net/es/1", "http://net/fr/",
    "http://n.net/es", "a://b://c.net/fr/", "http://ÄBC.com/ü?#", "http://h.com?x=/en/", "http://h.com#/en/", "http://h.net:80/es/", "x://ho\nst.com/a\nb?c",
    "http://" + "a" * 70_000 + ".com/" + "b" * 70_000,
]


def plain_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = rest[:end], rest[end:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [r for r in queries.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path), default=None)
    return host, path, best and best.host + best.path, best and best.verdict


def test_url_parts_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string, rule string")
    got = urls.judge(pages, queries.URL_RULES, urls.fit(urls.examples(spark))).collect()
    assert len(got) == len(URLS) * 2
    for r in got:
        host, path, rule, verdict = plain_url(r.page.url)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.block_probability >= 0.5 else "allow"))


def test_url_query_against_plain_rules(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()}
    got = queries.op4_url_filter(spark, SF).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        host, path, rule, verdict = plain_url(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict)


def test_url_model(spark):
    """What it says of hosts that it has not seen."""
    model = urls.fit(urls.examples(spark))
    hosts = {"win-casino-now.org": 1, "pokerslots24.net": 1, "my-pills.info": 1, "a.free-porn.org": 1, "uni-library.org": 0, "weatherforum.net": 0, "qzrtwk.org": 0, "townmuseum.de": 0}
    rows = spark.createDataFrame([(h, "/en/7") for h in hosts], "host string, path string")
    got = {r.host: r.block_probability for r in model.add_probability(rows).collect()}
    assert {h: int(p >= 0.5) for h, p in got.items()} == hosts


def test_url_model_without_both_labels(spark):
    rows = spark.createDataFrame([("h", "/p")], "host string, path string")
    for verdicts, p in (([], 0.0), (["allow"], 0.0), (["block", None, "other"], 1.0)):
        labelled = spark.createDataFrame([(f"http://a{i}.b/", v) for i, v in enumerate(verdicts)], "url string, verdict string")
        assert urls.fit(labelled).add_probability(rows).first().block_probability == p
    many = spark.createDataFrame([(f"http://bad{i}.x/", "block") for i in range(40)] + [(f"http://good{i}.x/", "allow") for i in range(40)], "url string, verdict string")
    assert urls.fit(many, max_labelled=50).regression is not None
    pages = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(pages, queries.URL_RULES, urls.fit(urls.examples(spark))).count() == 0


def test_clashing_column_names(spark):
    """Columns named like results are replaced; others come along."""
    texts = ["the house and the garden of the king", "das Haus und der Garten des Königs", None]
    docs = spark.createDataFrame(
        [(i, t, ("en", "de", None)[i % 3], "x", 9.0, 7.0, True, 5) for i, t in enumerate(texts * 8)],
        "doc_id long, text string, lang string, lang_pred string, score double, mean_ratio double, held_out boolean, predicted int",
    )
    said = languages.fit(docs).predict(docs)
    assert said.columns == ["doc_id", "lang", "mean_ratio", "held_out", "predicted", "lang_pred", "score"]
    assert {r.lang: r.lang_pred for r in said.collect()} == {"en": "en", "de": "de", None: "und"}
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(24)], "doc_id long, toxic int")
    scored = toxicity.classify(docs, labels)
    assert sorted(scored.columns) == ["doc_id", "held_out", "lang", "lang_pred", "predicted", "score"]
    assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in scored.collect())


def test_documents_of_many_languages():
    """Seven languages in equal parts are all found; the share of the first is not that of a smaller set."""
    languages_, per = 9, 40
    likely = np.full((languages_ * per, languages_), 1e-4)
    for k in range(languages_):
        likely[k * per : (k + 1) * per, k] = 0.02
    for n in (1, 3, 5, 7):
        grams = np.arange(n * per)
        share = languages.choose(np.zeros(n * per, int), np.full(n * per, 3.0), likely[grams], 1)[0]
        assert np.allclose(share[:n], 1 / n, atol=0.02) and share[n:].sum() < 0.01
