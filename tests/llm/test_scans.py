import base64
import html
import random
import re
import time
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm.conftest import HARD
from rillmeter.llm import decontaminate as dc
from rillmeter.llm import html_text, language, licenses, secrets, toxicity

BASE = (
    ("assign", r"""(?ai:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
    ("access", "(AKIA[A-Z0-9]+)", 20),
    ("hex", "([0-9a-f]+)", 24),
)


def base_spans(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p, n) in enumerate(BASE) for m in re.finditer(p, text or "") if len(m[1]) >= n]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


def test_secrets_equal_brute_force(spark, documents, hard, nothing):
    extra = ["password=abc", "passwd=token:abcdefgh", "日本𝄞 API_KEY : 'x.y-z=12345' é AKIA" + "A1" * 9, "a" * 23 + " " + "a" * 24, "token==abcdef", "secret: token=abcdefg"]
    rows = [(i, t) for i, t in enumerate(extra)] + [(r["doc_id"] + 100, r["text"]) for r in documents.collect()]
    rows += [(10**6 + i, t) for i, (_, t, *_) in enumerate(HARD)]
    got = secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", secrets.written("base").alias("b")).collect()
    assert {r["doc_id"]: r["b"] for r in got} == {i: base_spans(t) for i, t in rows}
    assert secrets.scan_secrets(hard).count() == len(HARD) and secrets.scan_secrets(nothing).count() == 0


def test_random_tokens_are_told_from_structured_ones(spark):
    rng = random.Random(1)
    rows = [(i, "k " + base64.b64encode(rng.randbytes(30)).decode() + " e") for i in range(80)]
    rows += [(100 + i, "k " + "".join(rng.choice(["The", "ring", "And", "of"]) for _ in range(7)) + "ABcd" + "aeiouAB12" * 3) for i in range(80)]
    got = {r["doc_id"]: r["n_random"] for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] for i in range(80)) >= 64
    assert sum(got[100 + i] for i in range(80)) <= 4


def test_many_tokens_in_one_text_take_little_time(spark):
    rng = random.Random(9)
    n = 100_000
    tokens = [rng.randbytes(14).hex() for _ in range(n)]
    text = "k " + " ".join(tokens)
    began = time.monotonic()
    got = secrets.scan_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).select("n_hex", "n_random", secrets.written("base").alias("b")).first()
    assert time.monotonic() - began < 60
    assert (got["n_hex"], got["n_random"], got["b"]) == (n, 0, base_spans(text))


def test_spans_apart_from_others(spark):
    rng = random.Random(10)

    def some(n):
        starts = [rng.randrange(60) for _ in range(n)]
        return sorted((a, a + rng.randint(1, 6)) for a in starts)

    rows = [(k, some(rng.randrange(12)), some(rng.randrange(12))) for k in range(300)]
    kind = "array<struct<start:int,end:int>>"
    df = spark.createDataFrame(rows, f"id int, s {kind}, o {kind}")
    got = {r["id"]: [tuple(x) for x in r["apart"]] for r in secrets.with_apart(df, "apart", "s", "o").collect()}
    assert got == {k: [(a, b) for a, b in s if not any(c < b and a < d for c, d in o)] for k, s, o in rows}


def test_random_values_behind_names_are_found(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for i in range(240):
        value = base64.urlsafe_b64encode(rng.randbytes(30)).decode() if i % 3 else base64.b64encode(rng.randbytes(13)).decode()
        before = ("SESSION_SIG=", "GET /a?x=1&sig=", "[main]\nsalt=", "padded ")[i % 4]
        rows.append((i, f"{before}{value}\nend"))
        want[i] = f"random:{len(before)}:{len(before) + len(value)}"
    got = secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", secrets.written("found").alias("f")).collect()
    for kind in range(4):
        some = [r["f"] == want[r["doc_id"]] for r in got if r["doc_id"] % 4 == kind]
        assert sum(some) >= 0.8 * len(some)


def brute_hits(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, found = set(), set()
    for item, other in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), other or ""))
        n = min(10, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for i in range(len(words) - n + 1 if windows else 0):
            if tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


def test_decontamination_equals_brute_force(spark, hard, nothing):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(30)] + ["é", "x9"]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 5, 10, 14, 30])))) for k in range(25)] + [(90, None), (91, ""), (None, "w1"), (3, "again w1 w2")]
    rows = [(k, ", ".join(rng.choice([rng.choice(words).upper(), rng.choice(items)[1] or "--"]) for _ in range(rng.randint(0, 30)))) for k in range(120)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {i: brute_hits(t, [x for x in items if x[0] is not None]) for i, t in rows}
    for size in (dc.MAX_ITEM_BYTES, 300):  # one automaton, then several shards
        got = dc.contaminated_words(docs, bench, max_item_bytes=size).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in got} == want
    tokens = [windows for _, windows, _ in dc._shards(bench, "item_id", "text", 10, 300)]
    assert len(tokens) > 2 and sum(len(w.value) for w in tokens[:1]) < sum(len(w.value) for w in tokens) / 2
    texts = dict(rows)
    for r in got:
        cut = [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"]]
        assert sum(len(dc.words_of(c)) for c in cut) == r["n_hit"]
    kept = dc.drop_contaminated(docs, bench)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, w in want.items() if not w[1]}
    assert dc.contaminated_words(hard, bench).count() == len(HARD)
    assert dc.contaminated_words(hard, bench.limit(0)).where("n_hit > 0").count() == 0
    assert dc.contaminated_words(nothing, bench).count() == 0 and dc.drop_contaminated(hard, bench).columns == hard.columns


def edits(a, b):
    """Insertions, deletions, substitutions and swaps of neighbours that turn a into b."""
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 2] == b[j - 1] != a[i - 1] == b[j - 2]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def distance(a, b, stem):
    """For a stem, to the nearest beginning of b in which its last letter is as it was or swapped with the one before."""
    if not stem:
        return edits(a, b)
    found = [99]
    for k in range(1, len(b) + 1):
        if b[k - 1] == a[-1]:
            found.append(edits(a[:-1], b[: k - 1]))
        if k > 1 and b[k - 2 : k] == a[-1] + a[-2] and a[-1] != a[-2]:
            found.append(edits(a[:-2], b[: k - 2]) + 1)
    return min(found)


def test_product_automaton_equals_edit_distance():
    entries = [("idiot", False), ("moron", False), ("disgusting", False), ("scum", False), ("réeux", True), ("trash", False), ("hate", True), ("imbec", True)]
    whole = toxicity.compile_shards(entries)
    parts = toxicity.compile_shards(entries, max_states=len(whole[0].moves) - 1)
    assert len(whole) == 1 and len(parts) > 1
    rng = random.Random(4)
    texts = [w for w, _ in entries] + ["idi0t", "idot", "iidiot", "dsgustng", "disgussting", "scam", "réeuxtion", "reeux", "tr@sh", "xtrash", "scvm", "idoit", "trsah", "imbceile", "imebcile", "imbxc", "haet", ""]
    for word, _ in entries:
        for _ in range(150):
            w = list(word)
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(w) + 1)
                if rng.random() < 0.3:
                    w[k : k + 2] = w[k : k + 2][::-1]
                    continue
                w[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "i", "o", "z9"])
            texts.append("".join(w))
    for automata in (whole, parts):
        owner, _, _, entry, errors, _ = toxicity.find_words(texts, automata)
        got = {int(k): (int(e), int(n)) for k, e, n in zip(owner, errors, entry)}
        for k, text in enumerate(texts):
            near = [(d, n) for n, (w, s) in enumerate(entries) if (d := distance(w, text, s)) <= toxicity.allowed_errors(len(w), s)]
            assert got.get(k) == (min(near) if near and text else None), text
        assert len(entry) == len(got)
    assert [toxicity.find_words([w], whole)[3].tolist() for w in ("scvm", "idoit", "trsah", "idi0t")] == [[3], [0], [5], [0]]


def test_an_entry_of_any_length_is_looked_for():
    word = "ab" * 300
    automata = toxicity.compile_shards([("idiot", False), (word, False)], max_states=200)
    assert toxicity.find_words([word, "idoit", word + "c"], automata)[3].tolist() == [1, 0]


def test_every_text_is_counted(spark):
    rng = random.Random(8)
    words = [f"{a}{b}{c}rd" for a in "bdfgklmnprst" for b in "aeiou" for c in "lmnrst"]
    texts = ["shared " + " ".join(rng.sample(words, rng.randint(5, 40))) for _ in range(300)]
    rows = [(i, t, int(i % 5 == 0)) for i, t in enumerate(texts)]
    copies = [(1000 + i, t + " more", y) for i, t, y in rows if len(t.split()) > 20]
    want = {0: Counter(), 1: Counter()}
    for _, t, y in rows:
        want[y].update(toxicity._terms(t))
    for tasks in (1, 8):
        docs = spark.createDataFrame(rows + copies, "doc_id long, text string, toxic int").repartition(tasks, "doc_id")
        kept = toxicity.without_copies(docs)
        assert {r["doc_id"] for r in kept.collect()} == {i for i, *_ in rows}
        got = {r["term"]: (r["toxic"], r["clean"]) for r in toxicity.term_counts(kept).collect()}
        assert got == {w: (want[1][w], want[0][w]) for w in want[0] | want[1]}


def test_quotation_is_told_from_abuse():
    text = 'he said "you idiot" to me'
    assert toxicity.is_quoted(text, 13, 18)
    assert toxicity.is_quoted("the word idiot is old", 9, 14)
    assert not toxicity.is_quoted("you are an idiot and more", 11, 16)


@pytest.fixture(scope="module")
def model(spark, documents, sf_dir):
    return toxicity.fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def test_term_counts_are_handed_on_while_rows_come(monkeypatch):
    """What a task counts must not grow with the words of its rows."""
    monkeypatch.setattr(toxicity, "HELD_TERMS", 1_000, raising=False)
    read, ahead, got = [], [], Counter()
    texts = [f"same {' '.join(f'w{chr(97 + i)}{chr(97 + j)}{chr(97 + k)}x' for j in range(10) for k in range(10))}" for i in range(20)]

    def batches():
        for i, text in enumerate(texts):
            read.append(i)
            yield pa.RecordBatch.from_pydict({"text": [text, text], "toxic": [i % 2, 0]})

    for out in toxicity._term_counts(batches()):
        ahead.append(len(read))
        for r in out.to_pylist():
            got[r["term"], 1] += r["toxic"]
            got[r["term"], 0] += r["clean"]
    assert ahead[0] < 10
    assert +got == Counter((t, kind) for i, text in enumerate(texts) for kind in (i % 2, 0) for t in toxicity._terms(text))


def test_toxicity_holds_on_held_out_rows(spark, documents, sf_dir, model):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = toxicity.toxicity(documents, model).join(labels, "doc_id").collect()
    for held_out in (True, False):
        some = [r for r in rows if r["held_out"] == held_out]
        assert sum(r["predicted"] == r["toxic"] for r in some) >= 0.94 * len(some)
        assert sum(r["predicted"] for r in some if not r["toxic"]) <= 0.02 * len(some)


def test_fit_does_not_depend_on_the_order_of_rows(documents, sf_dir, spark, model):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    for turned in (documents.orderBy(documents["doc_id"].desc()), documents.repartition(5, "text")):
        again = toxicity.fit(turned, labels)
        assert len(again.automata) == len(model.automata) and (again.evidence == model.evidence).all() and again.common == model.common
        assert all((a.moves == b.moves).all() for a, b in zip(again.automata, model.automata))
        assert (again.weights == model.weights).all() and again.bias == model.bias


def test_toxicity_on_hard_rows(spark, hard, nothing, model):
    got = toxicity.toxicity(hard, model).collect()
    assert len(got) == len(HARD) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert toxicity.drop_toxic(hard, model).columns == hard.columns and toxicity.toxicity(nothing, model).count() == 0
    none = toxicity.fit(hard, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r["score"] < 0.01 for r in toxicity.toxicity(hard, none).collect())


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header>Site name</header><nav><a href=/a>Home</a> <a>News</a></nav>
<!-- ad --><article class="post"><h1>Head &amp; line</h1><p>First <b>bold</b>
 text<br>second<p>Unclosed<div class="ad-banner">Buy now this long advert of many words that goes on and on and on</div><p>Last</p>
<section id=comments><p>I liked this article a lot and so did all my friends who read it</p></section></article><script>var t="</p>";</script>
<aside>See also many other things that were written here</aside><form>Name <input name=x></form><footer>&copy; us</footer></body></html>"""


def test_main_text(spark, sf_dir):
    assert html_text.main_text(PAGE) == "Head & line First bold text second Unclosed Last"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p") == ""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()}
    for r in rows:
        body = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)[1]
        assert got[r["page_id"]] == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub("</?b>", "", body))).split())


@pytest.mark.parametrize(
    "page, want",
    [
        ("<html><head><title>t</title><body><article><p>Main text</p></article>", "Main text"),
        ("<head><title>t</title><noscript><p>no</p></noscript><p>" + "text " * 30, ("text " * 30).strip()),
        *[(f"<article><p>One</p><{t} id=x>gone<p>Two</p><p>Three</p></article>", "One Two Three") for t in sorted(html_text.UNREAD)],
        *[(f"<article><p>One <{t}>gone<{t}>gone</{t}><p>gone</p></{t}> two</p></article>", "One two") for t in sorted(html_text.UNREAD)],
        ("<article><p>One<div><select><option>gone</div><p>Two</p><select><option>gone</select><p>Three</p>", "One Two Three"),
        ("<article><p>One</p><object/><p>Two</p><script>gone<p>gone", "One Two"),
        ("<article><p>One</p><!-- <select> --><p>Two</p><textarea>gone<p>gone", "One Two"),
    ],
)
def test_unclosed_elements_do_not_swallow_the_page(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize("wrapper", ["div class=with-sidebar", "div class='page sidebar'", "main class=has-sidebar", "article class='post comments-open'", "form id=aspnetForm", "form class=search"])
def test_wrappers_do_not_empty_a_page(wrapper):
    name = wrapper.split()[0]
    text = " ".join(f"word{k}" for k in range(200))
    inside = f"<nav><p>{text}</p></nav><div class=site-header>Site</div><article><p>Short text</p></article><section class=comments><article><p>{text}</p></article></section>"
    assert html_text.main_text(f"<body><{wrapper}>{inside}</{name}>") == "Short text"
    assert html_text.main_text(f"<body><{wrapper}><p>{text}</p><p><a>{text}</a></p></{name}>") == text
    many = [" ".join(f"word{k}" for k in range(40))] * 5
    if "=search" not in wrapper and " sidebar" not in wrapper:
        assert html_text.main_text(f"<body><{wrapper}>" + "".join(f"<p>{t}</p>" for t in many) + f"</{name}>") == " ".join(many)


def test_stray_end_tags_take_linear_time():
    began = time.monotonic()
    page = "<article>" + "<div>" * 100_000 + "</ul>" * 100_000 + "<p>Some words of a text that stays where it is</p></article>"
    assert html_text.main_text(page).startswith("Some words")
    assert time.monotonic() - began < 10


def test_pages_with_nulls_and_repeats(spark):
    pages = spark.createDataFrame([(1, None, None), (1, "x", PAGE), (1, "x", PAGE), (None, "http://a.de/x", "<p>" + "wort " * 100_000)], "page_id long, url string, html string")
    got = html_text.extract(pages.selectExpr("*", "1 AS text", "2 AS n_chars")).collect()
    assert Counter(r["n_chars"] for r in got) == Counter({0: 1, 48: 2, 499_999: 1}) and html_text.extract(pages.limit(0)).count() == 0


def test_language_fuses_evidence(spark, documents, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = language.detect(pages, documents).collect()
    assert len(got) == pages.count()
    truth = {r["page_id"]: re.search(r"://[^/]*/(\w\w)/", r["url"])[1] for r in got}
    assert sum(r["lang"] == truth[r["page_id"]] for r in got) >= 0.97 * len(got)
    french = [f"http://h{i}.chez.fr/{k}" for i in range(6) for k in range(20)]
    text = documents.where("lang = 'fr' and length(text) > 300").first()["text"]
    rows = [(k, u, f'<html lang="fr"><article><p>{html.escape(text)}</p></article>') for k, u in enumerate(french)]
    rows += [(1000, "http://h1.chez.fr/empty", "<html></html>"), (1001, None, None), (1001, None, None)]
    by = {r["page_id"]: r for r in language.detect(spark.createDataFrame(rows, "page_id long, url string, html string"), documents).collect()}
    assert by[1000]["lang"] == "fr" and by[1000]["text_lang"] is None  # from its host and suffix alone
    assert by[1001]["n_grams"] == 0
    assert language.detect(pages.limit(3), documents.limit(0)).where("lang is null").count() == 3
    assert language.detect(pages.limit(0), documents).count() == 0


@pytest.mark.parametrize(
    "before, want",
    [("", "fr"), (f"<!-- {'x' * 5000} -->", "fr"), (" " * 5000, "fr"), ("<!--[if IE]><html lang=de><![endif]-->", "fr"), (f"<script>var t = '<html lang=de>';{' ' * 5000}</script>", "fr"), ("<html>", "fr")],
)
def test_declared_language_is_found_anywhere(before, want):
    assert language.declared_language(f'{before}<html class=x lang="FR-ca"><p>text</p>') == want
    assert language.declared_language(f"{before}<p lang=fr>text</p>") == ""


def test_a_hot_host_is_split_over_tasks(spark, documents):
    from test_dedup import executed, small_skew

    text = documents.where("lang = 'fr' and length(text) > 300").first()["text"][:300]
    host = F.when(F.col("id") % 3 > 0, "www.hot.com").otherwise(F.concat(F.lit("h"), "id", F.lit(".net")))
    pages = spark.range(0, 3000, 1, 8).select(F.col("id").alias("page_id"), F.concat(F.lit("http://"), host, F.lit("/")).alias("url"), F.lit(f"<p>{text}</p>").alias("html"))
    with small_skew(spark):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
        try:
            rows, plan = executed(language.detect(pages, documents))
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
            spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert "skew=true" in plan and len(rows) == 3000 and {r["lang"] for r in rows} == {"fr"}


def test_too_many_languages_raise(documents):
    with pytest.raises(ValueError):
        language.fit(documents, most_languages=2)


def test_hosts_of_one_site_share_their_pages(spark, documents):
    french, english = (documents.where(f"lang = '{lang}' and length(text) > 300").first()["text"] for lang in ("fr", "en"))
    page = "<article><p>{}</p></article>".format
    rows = [(k, f"http://www.site.com/{k}", page(french)) for k in range(30)] + [(100 + k, f"http://www.other{k}.com/", page(english)) for k in range(60)]
    rows += [(1000, "http://blog.site.com/", ""), (1001, "http://site.com/", ""), (1002, "http://a.b.site.com/", ""), (1003, "http://blog.new.com/", ""), (1004, "http://com/", "")]
    by = {r["page_id"]: r["lang"] for r in language.detect(spark.createDataFrame(rows, "page_id long, url string, html string"), documents).collect()}
    assert [by[k] for k in range(1000, 1005)] == ["fr", "fr", "fr", "en", "en"]


MIT = """Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction.

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."""


GPL3 = """ # This program is free software: you can redistribute it and/or modify
 # it under the terms of the GNU General Public License as published by
 # the Free Software Foundation, either version 3 of the License, or
 # (at your option) any later version.
 #
 # This program is distributed in the hope that it will be useful,
 # but WITHOUT ANY WARRANTY."""

APACHE = """/* Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * See the License for the specific language governing permissions and
 * limitations under the License.
 */"""

BSD = "Redistribution and use in source and binary forms, with or without modification, " + "of all the many parts named here " * 60 + """are permitted provided that:
1. Redistributions of source code must retain the above copyright
   notice.
2. Redistributions in binary form must reproduce the above copyright notice.
3. Neither the name of Foo Inc. nor the names of its contributors
   may be used to endorse or promote products derived from this software.

THIS SOFTWARE IS PROVIDED BY X "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES"""


@pytest.mark.parametrize(
    "text, want",
    [
        (MIT, ["MIT"]),
        ("MIT License\n\n" + MIT, ["MIT"]),
        ("\n".join(" ".join(MIT.split()[k : k + 2]) for k in range(4, 60, 2)), ["MIT"]),
        (BSD, ["BSD-3-Clause"]),
        (GPL3, ["GPL-3.0-or-later"]),
        (APACHE, ["Apache-2.0"]),
        ("Words before. Licensed under the Apache License, Version 2.0. Words after.", ["Apache-2.0"]),
        ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ["CC-BY-SA-4.0"]),
        ("Creative Commons Attribution-ShareAlike 4.0 International License", ["CC-BY-SA-4.0"]),
        ("Released under the MIT License.\nThis work is licensed under the GNU General Public License, version 3.", ["MIT", "GPL-3.0"]),
        ("Licensed under the MIT license (see LICENSE).", ["MIT"]),
        ("Dual licensed under either the MIT license or the Apache License, Version 2.0, at your option.", ["MIT", "Apache-2.0"]),
        ("SPDX-License-Identifier: BSD-3-Clause", ["BSD-3-Clause"]),
        ("SPDX-License-Identifier: MIT OR Apache-2.0", ["MIT", "Apache-2.0"]),
        ("/* SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0 AND mit) */", ["GPL-2.0-or-later WITH Classpath-exception-2.0", "MIT"]),
        ("GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007", ["AGPL-3.0"]),
        ("It is licensed under the AGPLv3+.", ["AGPL-3.0-or-later"]),
        ("Licensed under the GNU LGPL, version 2.1 only", ["LGPL-2.1-only"]),
        ("Distributed under the Boost Software License, Version 1.0.", ["BSL-1.0"]),
        ("This program is made available under the terms of the Eclipse Public License 2.0 which is available at x", ["EPL-2.0"]),
        ("This is free and unencumbered software released into the public domain.", ["Unlicense"]),
        ("Copyright 2001 Us. All rights reserved.", ["proprietary"]),
        ("My driving license is red. Copyright is a word. In 1999 it was.", []),
        ("The book was published by MIT press under licence. It was not licensed under the MIT license.", []),
    ],
)
def test_license_rules(text, want):
    spans, _, _ = licenses.scan(text)
    assert [s["license"] for s in spans] == want
    for s in spans:
        assert s["license"] in [x["license"] for x in licenses.scan(text[s["start"] : s["end"]])[0]]


def brute_rules(ids):
    """The rules as one regular expression over letters that stand for identifiers."""
    names = sorted({step.rstrip("?") for _, rule in licenses.RULES for step in rule} | set(ids))
    letter = {name: chr(0x4E00 + k) for k, name in enumerate(names)}
    rules = ["".join(letter[step.rstrip("?")] + "?" * step.endswith("?") for step in rule) for _, rule in licenses.RULES]
    pattern = re.compile("|".join(f"({rule})" for rule in rules) + "|(.)")
    found = list(pattern.finditer("".join(letter[i] for i in ids)))
    return [(licenses.RULES[m.lastindex - 1][0] or "" if m.lastindex <= len(rules) else None, *m.span()) for m in found]


def test_rules_equal_brute_force():
    rng = random.Random(4)
    steps = sorted({step.rstrip("?") for _, rule in licenses.RULES for step in rule}) + ["unheard-of"]
    for _ in range(300):
        ids = []
        while len(ids) < 30:
            rule = rng.choice(licenses.RULES)[1]
            ids += [s.rstrip("?") for s in rule if not s.endswith("?") or rng.random() < 0.5] if rng.random() < 0.7 else [rng.choice(steps)]
        assert licenses.match(ids) == brute_rules(ids)


def test_every_known_sentence_is_looked_for():
    for name, pattern in licenses.SENTENCES:
        plain = re.sub(r"\(\?:([^()|]*?)(?:\|[^()]*)?\)\??", r"\1", pattern)
        plain = re.sub(r" \.{2,3}(?: |\|?$)", " x ", plain).replace(r"\d{4}", "1999").replace(r"\d ", "").replace(r"\w+", "x").replace("[sz]", "z").replace("?", "")
        found = [s[2] for s in licenses.sentences(f"Some words.\n\n{plain}\n\nOther words.")]
        assert found and found[0] == name, plain


def test_licence_sentences_of_any_length():
    gap = "word " * 200_000
    names = ["MIT", "X11", "the 3-clause BSD", "the new BSD", "BSD-2-Clause", "GPLv3", "the terms of the LGPL v2.1", "EPL 2.0", "CC BY 4.0", "zlib", "Apache 2.0", "CC0", "GNU GPL"]
    assert all(licenses.scan(f"It is released\nunder {name} by us.")[0] for name in names)
    text = f"Redistribution and use in source and binary forms {gap} are permitted. " + "Neither the name of a b. Licensed under MIT or MIT.\n" * 5_000
    began = time.monotonic()
    spans, ids, left = licenses.scan(text)
    assert time.monotonic() - began < 10
    assert [s["license"] for s in spans] == ["BSD"] + ["MIT"] * 10_000 and not left


def test_licenses_of_all_documents(documents, hard, nothing):
    known = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
             "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    for r in licenses.scan_licenses(documents).collect():
        assert r["licenses"] == sorted({n for line, n in known.items() if line in texts[r["doc_id"]]})
    assert licenses.scan_licenses(hard).count() == len(HARD) and licenses.scan_licenses(nothing).count() == 0
