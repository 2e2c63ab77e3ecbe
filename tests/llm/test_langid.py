"""Languages of pages, the pull of each piece of evidence, and odd inputs."""

import html
import random
import re
import time

import numpy as np
import pytest

from factorloom.llm import langid
from factorloom.llm.common import table

PAGES, DOCS = "page_id long, url string, html string", "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def model(spark):
    return langid.train(table(spark, "/root/testdata/sf0.01", "documents"))


def test_languages_of_documents_as_pages(spark, model):
    docs = table(spark, "/root/testdata/sf0.01", "documents").where("length(text) > 200")
    pages = docs.selectExpr("doc_id AS page_id", "concat('http://host', doc_id % 7, '.net/') AS url", "concat('<html><body><p>', text, '</p></body></html>') AS html")
    got = langid.identify(pages, *model).join(docs.selectExpr("doc_id AS page_id", "lang AS wanted"), "page_id").toPandas()
    assert (got.lang == got.wanted).mean() > 0.95
    assert got.confidence.between(0, 1).all()


def test_every_page_has_an_answer(spark, model):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    got = langid.identify(pages, *model).toPandas()
    assert len(got) == pages.count() and got.lang.notna().all()


def test_other_evidence_decides_where_text_does_not(spark, model):
    languages, _ = model
    a, b = languages[0], languages[1]
    docs = table(spark, "/root/testdata/sf0.01", "documents").where("length(text) > 500")
    text = {r["lang"]: r["text"] for r in docs.collect()}
    rows = [(k, "http://one.net/x", f"<html lang={a}>{text[a]}</html>") for k in range(40)]
    rows += [(100 + k, "http://two.net/x", f"<html lang={b}>{text[b]}</html>") for k in range(40)]
    # No text at all: one page declares its language, one stands on a host of one language.
    rows += [(200, "http://three.net/", f'<html lang="{b}"></html>'), (201, "http://two.net/y", ""), (202, "http://one.net/y", None)]
    got = {r["page_id"]: r["lang"] for r in langid.identify(spark.createDataFrame(rows, PAGES), *model).collect()}
    assert got[200] == b and got[201] == b and got[202] == a


def plain_fusion(pages, languages, likelihood):
    """The whole posterior of every page with plain loops; a page's own counts are left out of its sums."""
    small, k = likelihood.astype(np.float32), len(languages)
    texts, softs, hosts = [], [], []
    for _, url, html in pages:
        slots = langid.trigram_slots(langid.visible_text(html or ""))
        total = small[slots].sum(0, dtype=np.float64) if len(slots) else np.zeros(k)
        log = (total - total.max()) * (min(1.0, langid.SATURATION / len(slots)) if len(slots) else 0.0)
        texts.append(log)
        softs.append(np.exp(log) / np.exp(log).sum())
        rest = (url or "").partition("://")[2]
        hosts.append(re.match("[^/?#]*", rest)[0].lower())
    labels = [h.split(".") for h in hosts]
    keys = {"host": hosts, "site": [".".join(x[-2:]) for x in labels], "declared": [langid.declared_language(p[2] or "") for p in pages], "suffix": [x[-1] for x in labels]}
    out = []
    for i in range(len(pages)):
        others = lambda name: sum((softs[j] for j in range(len(pages)) if j != i and (name is None or keys[name][j] == keys[name][i])), np.zeros(k))  # noqa: E731, B023
        share = lambda n, prior, strength: (n + prior * strength) / (n.sum() + strength)
        everything = share(others(None), np.full(k, 1 / k), 1.0)
        host = share(others("host"), share(others("site"), everything, langid.SITE_STRENGTH), langid.HOST_STRENGTH)
        logs = texts[i] + np.log(host)
        for name in ("declared", "suffix"):
            if keys[name][i]:
                logs = logs + np.log(share(others(name), everything, langid.TABLE_STRENGTH) / everything)
        p = np.exp(logs - logs.max())
        out.append(p / p.sum())
    return out


def test_fusion_by_brute_force(spark, model):
    languages, likelihood = model
    r = random.Random(3)
    docs = [x["text"] for x in table(spark, "/root/testdata/sf0.01", "documents").where("length(text) between 200 and 900").orderBy("doc_id").limit(40).collect()]
    urls = ["http://a.one.net/x", "http://b.one.net/", "https://two.de:80/?q", "http://x.fr", "nothing", None]
    pages = []
    for k in range(120):
        lang = r.choice([f' lang="{x}"' for x in languages] + ["", " class=x"])
        pages.append((k, r.choice(urls), r.choice([f"<html{lang}><p>{r.choice(docs)[: r.choice([0, 5, 20, 400])]}</p>", "", None])))
    want = plain_fusion(pages, languages, likelihood)
    got = {x["page_id"]: x for x in langid.identify(spark.createDataFrame(pages, PAGES), *model).collect()}
    for (i, _, _), p in zip(pages, want):
        assert abs(got[i]["confidence"] - p.max()) < 1e-9, i
        assert p[languages.index(got[i]["lang"])] > p.max() - 1e-9


SIMPLE = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
DECLARED = re.compile("(?i)<html\\b[^>]*?\\blang\\s*=\\s*[\"']?([a-z]{2,3})")


def test_scanners_equal_plain_patterns():
    r = random.Random(5)
    bits = ["<script", "<SCRIPT>", "</script", "</Script >", "<style", "</style>", "<!--", "-->", "--", "<", ">", "a", " ", "&lt;", "<html", " lang=", "lang = 'DE", "x", "<scripty", "lang", "=", "<html lang=fr>", "\n"]
    for _ in range(4000):
        text = "".join(r.choice(bits) for _ in range(r.randrange(0, 14)))
        assert langid.visible_text(text) == html.unescape(SIMPLE.sub(" ", text)), text
        found = DECLARED.search(text)
        assert langid.declared_language(text) == (found[1].lower() if found else ""), text


@pytest.mark.parametrize("bit", ["<!--", "<script ", "<style>", "<html ", "<", "<html lang", "<script></script", "&lt;<"])
def test_hostile_pages_take_linear_time(bit):
    text, start = bit * (2_000_000 // len(bit)), time.perf_counter()
    langid.trigram_slots(langid.visible_text(text))
    langid.declared_language(text)
    assert time.perf_counter() - start < 5


def test_a_very_long_page(spark, model):
    rows = [(1, "http://a.b/", "<!--" * 300_000), (2, "http://a.b/", "<p>the house and the river " * 200_000)]
    assert langid.identify(spark.createDataFrame(rows, PAGES), *model).count() == 2


def test_visible_text_and_trigrams():
    assert langid.visible_text("<p>a &amp; b</p><script>x < y</script><!-- c -->d").split() == ["a", "&", "b", "d"]
    assert len(langid.trigram_slots("")) == 0 and len(langid.trigram_slots("abc")) == 3
    assert (langid.trigram_slots("Ab, C") == langid.trigram_slots("ab  c")).all()


def test_odd_inputs(spark, model):
    rows = [(1, None, None), (2, "", ""), (None, "http://x.de/", "<p>wort</p>"), (1, None, None), (3, "x", "a" * 200_000)]
    got = langid.identify(spark.createDataFrame(rows, PAGES), *model).collect()
    assert len(got) == 5 and all(r["lang"] in model[0] for r in got)
    assert langid.identify(spark.createDataFrame([], PAGES), *model).count() == 0
    nothing = langid.train(spark.createDataFrame([(1, None, "de"), (2, "x", None)], DOCS))
    assert nothing[0] == [] and langid.identify(spark.createDataFrame(rows, PAGES), *nothing).where("lang is null").count() == 5
    odd = spark.createDataFrame([(1, "http://a.b/", "x", "h", 1, "s")], PAGES + ", host string, one int, declared string")
    assert langid.identify(odd, *model).first()["host"] == "a.b"
