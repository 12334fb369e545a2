"""Trained operators by held-out accuracy, page extraction by known pages, the pipeline by a plain version."""

import random
import re
import zlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from scourline.llm import density, langid, licenses, queries, simhash, toxicity
from scourline.llm.bpe import Codec
from scourline.plans.scratch import keep
from tests.llm.conftest import ODD
from tests.llm.test_native import brute_hits, brute_spans

SF, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


# Languages


def test_language_query_on_held_out_rows(spark):
    out = {r["doc_id"]: r for r in queries.QUERIES["op2_language_id"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert all(out[d["doc_id"]]["held_out"] == (fold(d["doc_id"], 4) == 2) for d in docs)
    held = [d for d in docs if out[d["doc_id"]]["held_out"]]
    assert sum(out[d["doc_id"]]["lang_pred"] == d["lang"] for d in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out.values())


def test_language_of_odd_texts(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.train(docs)
    got = {r["doc_id"]: r for r in langid.predict(odd, model).collect()}
    assert [i for i in got if got[i]["lang_pred"] == "und"] and {i for i in got if got[i]["lang_pred"] == "und"} == {0, 1, 2, 9}
    assert langid.predict(odd.limit(0), model).count() == 0
    none = langid.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in langid.predict(odd, none).collect()} == {"und"}
    one = langid.train(docs.where("lang = 'de'"))
    assert {r["lang_pred"] for r in langid.predict(odd, one).collect()} == {"und", "de"}


def test_language_weights_are_sparse_and_calibrated(spark):
    model = langid.train(spark.read.parquet(f"{SF}/documents.parquet"))
    assert (model.weights == 0).mean() > 0.5 and 0.03 < model.temperature < 13


def test_language_counts_do_not_depend_on_parts(monkeypatch):
    text = "Zwölf Boxkämpfer jagen Viktor quer über den Sylter Deich. " * 9
    found, counts = langid.features(text)
    codes = langid.letters(text)
    assert counts.sum() == sum(len(codes) - n + 1 for n in range(1, langid.ORDERS + 1))
    assert len(langid.letters("1 2 3 ...")) == 0 and langid.letters("a  1 b").tolist() == [32, 97, 32, 98, 32]


# Toxicity


def test_toxicity_query_on_held_out_rows(spark):
    out = {r["doc_id"]: r for r in queries.QUERIES["op3_toxicity"](spark, LARGER).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    assert all(r["held_out"] == (fold(i, 3) == 1) and r["predicted"] == int(r["score"] >= 0.7) for i, r in out.items())
    held = [i for i in labels if fold(i, 3) == 1]
    toxic, clean = ([out[i]["score"] for i in held if labels[i] == k] for k in (1, 0))
    # A few labels of these tables are wrong, and most of the words are in a few documents only.
    assert sum(s >= 0.7 for s in toxic) >= 0.8 * len(toxic) and sum(s >= 0.7 for s in clean) <= 0.01 * len(clean)


def toxic_corpus(n):
    rng = random.Random(n)
    clean = ["table", "window", "garden", "river", "music", "letter", "stone", "market"]
    bad = ["scumbag", "idiotic", "worthless"]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(clean) + rng.choice(["", "s", "ing"]) for _ in range(rng.randint(3, 60))]
        if i % 3 == 0:
            words[rng.randrange(len(words))] = rng.choice(bad)
        docs.append(sorted(set(words)))
        labels.append(int(i % 3 == 0))
    return docs, labels


def test_toxicity_hears_misspellings():
    model = toxicity.fit(*toxic_corpus(600))
    long = "table " * 20_000
    assert model.score("you scumbag") > 0.7 and model.score(long + "worthless") > 0.7
    assert model.score("you scummbag") > 0.5 > 0.2 > model.score("a garden letter") and model.score(long) < 0.2
    assert model.score("") == model.score("  ") < 0.2 and model.score("x" * 5000) < 0.7


def test_toxicity_of_odd_tables(spark, odd):
    model = toxicity.fit(*toxic_corpus(200))
    assert all(0 <= r["score"] <= 1 for r in toxicity.scores(odd, model).collect())
    assert toxicity.keep_clean(odd, model).columns == odd.columns and toxicity.scores(odd.limit(0), model).count() == 0
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.train(odd, none).score("x") < 0.01
    only = spark.createDataFrame([(1, 1), (2, 1), (None, 1), (3, None)], "doc_id bigint, toxic int")
    assert toxicity.train(odd, only).score("x") > 0.99


def test_samples_are_bounded_whatever_the_ids(spark):
    rows = spark.range(900).selectExpr("7L as doc_id", "concat('word', id % 300, ' und') as text", "if(id % 2 = 0, 'de', 'en') as lang")
    labels = spark.createDataFrame([(7, 1)], "doc_id bigint, toxic int")
    tokens, y = toxicity.sample(rows, labels, 20, "doc_id", "text", "toxic", None)
    assert len(tokens) == len(y) == 40 and len({t for x in tokens for t in x}) == 41
    got = []
    original, langid.fit = langid.fit, lambda found, **_: got.extend(found)
    try:
        langid.train(rows, most=30)
    finally:
        langid.fit = original
    assert 10 <= len(got) <= 60


# Licences


def test_licence_lines(spark):
    truth = {"apache": "Licensed under the Apache License, Version 2.0.", "mit": "Released under the MIT License.", "gpl": "GNU General Public License, version 3.", "cc-by-nc": "Licensed under CC BY-NC 4.0.", "all-rights-reserved": "All rights reserved."}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = {r["doc_id"]: r for r in queries.QUERIES["op1_license_scan"](spark, SF).collect()}
    assert {i: out[i]["families"] for i in docs} == {i: ",".join(sorted(k for k, v in truth.items() if v in t)) for i, t in docs.items()}


def test_licences_not_learnt_word_for_word(spark, odd):
    model = licenses.fit(["the river runs under the old bridge", "we may use all of the files without a word"] * 20)
    of = lambda t: model.classify(licenses.tokens(t))[0]
    assert of("Copyright (c) 1999 Jane Roe. All Rights Reserved") == "all-rights-reserved"
    assert of("Some words before. Licensed under the Apache license version 2.0 and words after") == "apache"
    assert of("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published") == "lgpl"
    for t in ("you may use the rights of all", "a licence to kill", "Licensed under the Foo License.", "permission denied"):
        assert of(t) == licenses.UNKNOWN
    got = {r["doc_id"]: r for r in licenses.scan(odd, model).collect()}
    assert got[0]["n_paragraphs"] == got[1]["n_paragraphs"] == 0 and all(r["families"] == "" for r in got.values())
    assert licenses.scan(odd.limit(0), model).count() == 0
    long = "word " * 500 + "Licensed under the Apache License, Version 2.0. " + "word " * 500
    assert "apache" in {model.classify(w)[0] for _, w in licenses.paragraphs(long)}


def test_licences_in_corpora_that_use_their_words():
    lines = ["the public domain of the city", "all of the rights were reserved for them", "she released a new song with her license", "under the bridge mit dem Hund"]
    model = licenses.fit(lines * 10)
    of = lambda t: model.classify(licenses.tokens(t))[0]
    assert of("This work is in the public domain.") == "cc0" and of("Released under the MIT License.") == "mit"
    assert of("All rights reserved.") == "all-rights-reserved" and {of(x) for x in lines} == {licenses.UNKNOWN}


def test_licences_wrapped_at_80_columns(spark):
    import textwrap

    model = licenses.fit(["the river runs under the old bridge", "we may use all of the files without a word"] * 20)
    rows, want = [], {}
    for family, templates in licenses.TEMPLATES.items():
        for t in templates:
            for mark in ("", "# ", " * ", "// ", "REM "):
                want[len(rows)] = family
                rows.append((len(rows), "\n".join(["int before = 1;", mark.strip(), *textwrap.wrap(t, 80, initial_indent=mark, subsequent_indent=mark), "", "after = 2"])))
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string"), model).collect()}
    assert [(rows[i][1], got[i]["families"]) for i in want if want[i] not in got[i]["families"].split(",")] == []
    assert all(got[i]["n_licence"] <= got[i]["n_paragraphs"] for i in want)


@pytest.fixture(scope="module")
def background(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    rng = random.Random(1)
    lines = [[" ".join(w) for _, w in licenses.paragraphs(t or "")] for t in texts]
    return [rng.choice(x) for x in lines if x]


def test_short_notices(background):
    model = licenses.fit(background[:400])
    of = lambda t: model.classify(licenses.tokens(t))
    want = {"MIT License": "mit", "This project is MIT licensed": "mit", "Apache License, Version 2.0": "apache", "Apache 2.0": "apache", "GPLv2 or later": "gpl", "GNU GPL version 2": "gpl", "Released under GPLv3": "gpl", "BSD 2-Clause": "bsd", "See LICENSE for the terms of the BSD license": "bsd", "CC BY-SA 3.0": "cc-by-sa"}
    assert {t: of(t)[0] for t in want} == want
    for t in ("a licence to kill", "Licensed under the Foo License.", "permission denied", "He studied at MIT and has a driving license", "all rights", "the Apache people", "copyright", ""):
        family, likeliest, unknown = of(t)
        assert family == licenses.UNKNOWN and 0 <= likeliest + unknown <= 1 + 1e-9


def test_templates_held_out_of_the_training(background):
    """Each template in a fold of five that isn't learnt from. Some have hardly a word in common with any other."""
    every = [(f, t) for f, ts in licenses.TEMPLATES.items() for t in [*ts, *licenses.SHORT.get(f, ())]]
    found = named = alarms = 0
    for k in range(5):
        model = licenses.fit(background[:400], frozenset(t for i, (_, t) in enumerate(every) if i % 5 == k))
        got = [(f, model.classify(licenses.tokens(t))[0]) for i, (f, t) in enumerate(every) if i % 5 == k]
        found += sum(a == b for a, b in got)
        named += sum(b != licenses.UNKNOWN for _, b in got)
        alarms += sum(model.classify(licenses.tokens(t))[0] != licenses.UNKNOWN for t in background[400:] if not re.search("(?i)licen|rights|public|apache|gnu|mit ", t))
    assert found >= 0.6 * len(every) and named - found <= 0.1 * len(every) and alarms == 0


def test_places_of_matches(spark):
    model = licenses.fit(["the river runs under the old bridge"] * 30)
    df = spark.createDataFrame([(1, "first\nMIT License\n\nThis Source Code Form is subject to the terms of the Mozilla\nPublic License, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/."), (2, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in licenses.scan(df, model).collect()}
    assert got[1]["families"] == "mit,mpl" and (1, 1, "mit") in [(m["line"], m["last_line"], m["family"]) for m in got[1]["matches"]]
    assert any((m["line"], m["last_line"], m["family"]) == (3, 5, "mpl") for m in got[1]["matches"]) and got[1]["unknown"] < 0.1
    assert (got[2]["matches"], got[2]["unknown"], got[2]["score"]) == ([], 1.0, 0.0)


# Pages

LONG = "A paragraph of running text that says enough to be a part of the story, and then some more. " * 4
PAGES = [
    (None, ""),
    ("", ""),
    ("plain &amp; simple", "plain & simple"),
    ("<p>one<p>two <b>three\n four</b><div>five</div>", "one\ntwo three four\nfive"),
    (f"<body><div id=top><a href=/>Home</a> <a href=/x>About</a></div><div class=content><h2>Title &lt;here&gt;</h2><p>{LONG}</p><p>Second with <a href=x>link</a> text&nbsp;too.</p><ul><li>one item</li><li>two items</li></ul></div><div class=sidebar>side {LONG}</div><section id=comments><p>{LONG}</p></section><footer>foot {LONG}</footer></body>", f"Title <here>\n{LONG.strip()}\nSecond with link text too.\none item\ntwo items"),
    (f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href=a>a</a></li></ul></nav><article><header><h1>Head</h1></header><p>{LONG}</p><aside>aside</aside><form><p>form</p></form><script>var a='<p>no</p>'</script><p>End.</p></article></body>", f"Head\n{LONG.strip()}\nEnd."),
    (f"<body><div class='cookie-notice'>{LONG}</div><section><p>{LONG}</p><p>{LONG}</p></section><section><p>{LONG}</p><p>Last.</p></section><div class='ad-box'>buy</div>", "\n".join([LONG.strip()] * 3 + ["Last."])),
    ("<p>cut off <b class='x", "cut off"),
    ("a<br>b<hr>c", "a\nb\nc"),
    ("<table><tr><td>x<td>y<tr><td>z</table>", "x\ny\nz"),
    ("</p></div><p>stray</p></b>", "stray"),
    ("<!-- no --><p>yes &copy; &#8364; &#x20AC; &bogus;</p><!-- open", "yes © € € &bogus;"),
    ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_pages(page, text):
    assert density.extract(page) == text


@pytest.mark.parametrize("name", ["layout has-sidebar", "content-with-sidebar", "no-comments", "post has-share search-result", "page sidebar"])
def test_wrappers_named_after_what_is_beside_the_text(name):
    inner = f"<h1>Head</h1><p>{LONG}</p><ol><li><a href=a>A reference</a></li><li><a href=b>Another one</a></li></ol><p>{LONG}</p>"
    text = "\n".join(["Head", LONG.strip(), "A reference", "Another one", LONG.strip()])
    rest = f"<div class=sidebar>side {LONG}</div><div id=comments><p>{LONG * 5}</p></div>"
    assert density.extract(f"<body><div class='{name}'><article>{inner}</article>{rest}</div><p>foot</p></body>") == text
    assert density.extract(f"<body><div class='{name}'><div class=text>{inner}</div>{rest}</div></body>") == text


ONE = LONG.strip()
INNER = f"<h1>Head</h1><p>{LONG}</p><section id='related-work'><h2>Related work</h2><p>{LONG}</p></section><section id='discussion'><h2>Discussion</h2><p>{LONG}</p></section><p class='share-price'>The share price rose.</p><div class='related'><a href=1>Read this too</a> <a href=2>And this</a></div><div class='ad-slot'>buy {LONG}</div><h2>Sources</h2><ul><li><a href=a>One source</a></li><li><a href=b>Another one</a></li></ul>"
SAID = "\n".join(["Head", ONE, "Related work", ONE, "Discussion", ONE, "The share price rose.", "Sources", "One source", "Another one"])


@pytest.mark.parametrize("tag", ["article", "main", "div", "section"])
def test_names_and_lists_within_the_article(tag):
    menu = "<div id=top><a href=/>Home</a> <a href=/x>About</a></div>"
    assert density.extract(f"<body>{menu}<{tag}>{INNER}</{tag}><footer>foot</footer></body>") == SAID
    assert density.extract(f"<body><form action=x>{menu}<{tag}>{INNER}</{tag}<input name=q></form></body>") == SAID
    sections = f"<section><h2>A</h2>{f'<p>{LONG}</p>' * 3}</section><section><h2>B</h2><p>{LONG}</p><p>Short.</p></section>"
    assert density.extract(f"<body>{menu}<{tag}>{sections}</{tag}></body>").split("\n") == ["A", ONE, ONE, ONE, "B", ONE, "Short."]
    two = f"<{tag}><h2>A</h2><p>{LONG}</p><p>{LONG}</p></{tag}><{tag}><h2>B</h2><p>{LONG}</p></{tag}>"
    assert density.extract(f"<body>{menu}<div>{two}</div><div class=comments><p>{LONG}</p></div></body>").split("\n") == ["A", ONE, ONE, "B", ONE]


def test_densities_of_a_small_tree():
    import math

    nodes = density.parse("<body><div>ab<p>cdef</p><p>gh <a href=x>ij</a></p></div></body>")
    density.weigh(nodes)
    of = {}
    for n in nodes:
        of.setdefault(n.tag, []).append(n)
    share = 2 / 10  # characters in links, of all

    def plain(c, t, lc, lt):
        base = math.log(c / (max(1, c - lc)) * lc + share * c + math.e)
        return c / max(1, t) * math.log(c / max(1, lc) * max(1, t) / max(1, lt)) / math.log(base)

    div, (p, q), a = of["div"][0], of["p"], of["a"][0]
    assert (div.chars, div.tags, div.link_chars, div.link_tags) == (10, 3, 2, 1) and (a.chars, a.link_chars) == (2, 2)
    for n, want in ((div, plain(10, 3, 2, 1)), (p, plain(4, 0, 0, 0)), (q, plain(4, 1, 2, 1))):
        assert n.density == pytest.approx(want)
    assert div.total == pytest.approx(p.density + q.density + div.density * 2 / 10)


@pytest.mark.parametrize("unit", ["<a ", "</b>", "<p>", '<a "', "<x y='", "<!--", "<![CDATA[", "<td><b>", "<header>", "<form class=ad>", "<b></i>"])
def test_broken_pages_take_time_in_proportion(unit):
    import time

    took = []
    for size in (100_000, 800_000):
        began = time.process_time()
        assert isinstance(density.extract(unit * (size // len(unit)) + "end"), str)
        took.append(time.process_time() - began)
    assert took[1] < 8
    assert density.extract("<div>" * 50_000 + "deep" + "</b>" * 50_000) == "deep"


def test_page_table(spark):
    pages = spark.createDataFrame([(i, "u" if i else None, p, "x") for i, (p, _) in enumerate(PAGES)], "page_id bigint, url string, html string, text string")
    got = {r["page_id"]: r for r in density.main_text(pages).collect()}
    assert {i: (r["text"], r["n_chars"]) for i, r in got.items()} == {i: (t, len(t)) for i, (_, t) in enumerate(PAGES)}
    assert density.main_text(pages.limit(0)).count() == 0


def test_page_query_keeps_articles_whole(spark):
    import html

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r["page_id"]: r["text"] for r in queries.QUERIES["op6_text_density"](spark, SF).collect()}
    for i, page in pages.items():
        assert density.extract(page.replace("article>", "div>")) == got[i]  # density decides, not the tag
        inner = page.split("<article>", 1)[1].split("</article>")[0]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1|br)>", inner)]
        assert got[i] == "\n".join(x for x in parts if x)


# The pipeline


def test_pipeline_against_the_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps, frames = [], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frames = keep(stage(spark, frames, sf), name)
        assert frames.columns == docs.columns
        steps.append({r["doc_id"]: r["text"] for r in frames.collect()})
    toxic, unique, clean, redacted = steps
    all_texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"), learn=toxicity.bucket(F.col("id"), 3) != 1)
    assert set(toxic) == {i for i, t in all_texts.items() if model.score(t) < 0.7}
    sets = {i: set(simhash.shingles(t.encode()).tolist()) for i, t in toxic.items()}
    alike = lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and alike(a, b):
                x, y = sorted((_find(root, a), _find(root, b)))
                root[y] = x
    assert set(unique) == {i for i in sets if _find(root, i) == i}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert set(clean) == {i for i, t in unique.items() if not brute_hits(t, items)[1]}
    assert set(redacted) == set(clean)
    for i, t in clean.items():
        spans = brute_spans(t)
        assert (redacted[i] == t) or spans
        assert not any(t[a:b] in redacted[i] for a, _, _, b in spans)
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        own = Codec(f.read(), public_tokenizers.PATTERN)
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert {i: r["ids"] for i, r in out.items()} == {i: plain.encode_ordinary(t) for i, t in redacted.items()}
    assert all(r["round_trip"] for r in out.values())


def _find(root, i):
    while root[i] != i:
        i = root[i]
    return i


def test_pipeline_of_odd_documents(spark, odd):
    docs = odd.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("bigint").alias("n_chars"))
    frames = docs
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        frames = keep(stage(spark, frames, SF), name)
    assert frames.count() == 8 and corpus_pipeline.STAGES[-1][1](spark, frames, SF).count() == 8
    assert len(ODD) == 11
