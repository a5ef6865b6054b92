"""Each operator against a brute-force version, held-out accuracy or a round trip, and on awkward rows."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringside.llm import chat_format, decontaminate, html_text, jaccard_join, language_id, license_scan, mixing, nearest, quality, toxicity

SF = "/root/testdata/sf0.001"
AWKWARD = [(1, None, "en", "s", "x"), (2, "", None, None, None), (3, "  \n", "en", "s", "x"), (4, "é" * 5, "en", None, "x"), (5, "one two", "en", "s", "x"),
           (5, "one two", "en", "s", "x"), (None, "no id at all here", "de", "s", "x"), (6, "mit license " * 3000, "en", "t", "x"), (7, "\x00\x7f{}[]", None, "t", "x")]
SCHEMA = "doc_id long, text string, lang string, source string, score string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def classes(rows):
    """Classes by comparing all sets of a small table."""
    sets = {}
    for i, text in rows:
        w = spaced(text)
        sets[i] = ({tuple(w[k:k + 5]) for k in range(len(w) - 4)} or {tuple(w)}) if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(words, places, tag):
    out = list(words)
    for p in places:
        out[p] = f"{tag}{p}"
    return " ".join(out)


def test_jaccard_classes(spark, docs):
    base = [f"w{k}" for k in range(120)]
    made = [(1000 + k, edited(base, [(7 * k + j * 31) % 120 for j in range(k % 4)], f"e{k}x")) for k in range(60)]
    made += [(2000, "only three words"), (2001, "Only THREE words"), (2002, "only three word"), (2003, "one"), (2004, "one"), (2005, "only three words only three")]
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()] + made
    got = jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == classes(rows)


def test_jaccard_chain_and_stars(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 130)]
    got = {r[0]: r[1] for r in jaccard_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {k: 100 for k in range(100, 130)}


def test_jaccard_pairs_follow_a_group_of_near_copies(spark, monkeypatch):
    """Texts of a large group that can link with no other bring no pair of theirs forward."""
    base = [f"w{k}" for k in range(150)]
    linked = [(k, edited(base, [(41 * k + 37 * j) % 150 for j in range(k % 3)], f"e{k}x")) for k in range(60)]
    alone = [(100 + k, edited(base, [(7 * k + 17 * j) % 150 for j in range(8)], f"e{100 + k}x")) for k in range(60)]
    seen, plain = {}, jaccard_join.frames.stored

    def stored(df, name="step", *more):
        out = plain(df, name, *more)
        seen[name] = seen.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard_join.frames, "stored", stored)
    got = jaccard_join.jaccard_classes(spark.createDataFrame(linked + alone, "doc_id long, text string"))
    want = classes(linked + alone)
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == want
    assert sum(want[i][1] == i for i, _ in alone) == 60
    assert seen.get("met", 0) + seen["pairs"] < 240


def test_jaccard_pivots_count_all_shared_tokens(spark):
    """Of 24 shared tokens only the first can be a link's first shared one, yet all 24 count."""
    live = [(t, node, 146, 8, node, 23 - t, t + 20 * (node - 1)) for t in range(24) for node in (1, 2)]
    live = spark.createDataFrame(live, "token long, node long, n long, l long, comp long, rest int, before long")
    assert [tuple(r) for r in jaccard_join._star_pairs(live, 0, 75, 100).collect()] == [(1, 2)]


def test_jaccard_with_every_token_hot(spark, docs, monkeypatch):
    want = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_classes(docs).collect()}
    monkeypatch.setattr(jaccard_join, "HOT_EXCESS", -1e12)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_classes(docs).collect()} == want


def test_jaccard_awkward(awkward, spark):
    got = {tuple(r) for r in jaccard_join.jaccard_classes(awkward).collect()}
    assert got == {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 5), (None, 1, None), (6, 2, 6), (7, 1, 7)}
    kept = jaccard_join.representatives(awkward)
    assert kept.columns == awkward.columns and sorted(str(r[0]) for r in kept.collect()) == ["1", "2", "3", "4", "5", "6", "7", "None"]
    assert jaccard_join.jaccard_classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_prefix_always_shares_enough():
    rng = np.random.default_rng(1)
    freq = rng.integers(0, 9, 1 << jaccard_join.SLOT_BITS).astype(np.int32)
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
        a = np.unique(rng.choice(pool, rng.integers(5, 50), replace=False))
        b = np.unique(np.concatenate([rng.choice(a, max(1, int(len(a) * rng.uniform(0.7, 1))), replace=False), rng.choice(pool, rng.integers(0, 6))]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 75 * (len(a) + len(b) - both):
            (x, m), (y, n) = (jaccard_join.prefix(s, freq, 2.0) for s in (a, b))
            assert len(np.intersect1d(x, y)) >= min(m, n)


def test_license_awkward(awkward, spark):
    got = {r["doc_id"]: r for r in license_scan.digest(awkward).collect()}
    assert got[6]["n_base"] == 3000 and got[6]["first_word"] == 0 and got[6]["last_word"] == 5998 and got[6]["base_labels"] == "mit"
    assert got[1]["n_words"] == 0 and got[1]["first_word"] is None and got[1]["labels"] == "" and got[1]["score"] == 0
    texts = [(1, "Licensed under the Apache License, Version 2.0 and GNU General Public License"), (2, "Permission is hereby granted, free of charge, to any person obtaining a copy"),
             (3, "no licence here"), (4, "MIT-License x mit\nLICENSE")]
    got = {r["doc_id"]: r for r in license_scan.digest(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got[1]["base_labels"] == "apache,gpl" and "apache-2.0" in got[1]["labels"].split(",") and got[2]["labels"] == "mit" and got[2]["n_base"] == 0
    assert got[3]["labels"] == "" and got[4]["n_base"] == 2 and got[4]["last_word"] == 3
    assert license_scan.digest(spark.createDataFrame([], SCHEMA)).count() == 0
    plan = license_scan.digest(awkward)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_license_gate_passes_every_rule(spark):
    duckdb = pytest.importorskip("duckdb")
    texts = ["Released under the GPL", "covered by the gpl.", "subject to the terms of the GPL", "altered source versions must be plainly marked as such", "This is free and unencumbered software",
             "Unauthorized copying of this file", "neither the name of x may endorse", "all rights\nreserved", "in the public\tdomain", "released under mit", "apache 2.0", "spdx", "", "public version of the gnu"]
    for _, key, tokens, _, _ in license_scan._sentences():
        for extra in (False, True):  # without and with the words that may be absent
            w = [t.lstrip("?").split("|")[-1 if extra else 0] for t in tokens if extra or t[0] != "?"]
            texts.append("\n".join(w).upper() + ("" if key in w else f" {key}"))
    rows = list(enumerate(texts))
    assert any("licen" not in t for t in texts[14:])
    got = {r["doc_id"]: r for r in license_scan.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i]["labels"] for i in range(11)) and not any(got[i]["labels"] for i in range(11, 14)) and all(got[i]["labels"] for i in range(14, len(rows)))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = con.execute(license_scan.ORACLE_SQL).fetchall()
    assert sorted(want) == sorted(tuple(got[i]) for i in got)


def brute_hits(text, items):
    w = alnum(text)
    hit, found = set(), set()
    for item, t in items:
        v = alnum(t)
        k = min(10, len(v))
        for i in range(len(v) - k + 1 if v else 0):
            for j in range(len(w) - k + 1):
                if w[j:j + k] == v[i:i + k]:
                    hit.update(range(j, j + k))
                    found.add(item)
    return len(w), len(hit), sorted(str(x) for x in found if x is not None)


def test_decontamination(spark, awkward):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    items = [(1, item), (2, "One  TWO"), (3, None), (4, "..."), (None, "no id at all"), (10, "mit license mit license")]
    more = [(20, f"x {item.upper()} y"), (21, item[:-3] + " " + item), (22, "beta " + item.replace("zeta", "z")), (23, "é one two é")]
    rows = [r[:2] for r in AWKWARD] + more
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((str(i), *(x := brute_hits(t, items))[:2], len(x[2]), hashlib.sha256(",".join(x[2]).encode()).hexdigest(), x[1] > 0) for i, t in rows)
    assert sorted((str(r[0]), *r[1:]) for r in decontaminate.digest(decontaminate.marked(frame, bench)).collect()) == want
    spans = decontaminate.marked(frame, bench).filter("doc_id = 20").first()
    assert spans["text"].encode()[slice(*spans["_spans"][0])].decode().lower() == item
    assert decontaminate.digest(decontaminate.marked(frame, bench.limit(0))).filter("contaminated").count() == 0
    assert decontaminate.clean(awkward, bench).columns == awkward.columns


def test_decontamination_in_blocks(spark, monkeypatch):
    items = [(k, " ".join(f"w{k}{j}" for j in range(12))) for k in range(6)]
    rows = [(1, items[0][1] + " " + items[5][1] + " " + items[5][1]), (2, items[3][1][:-4]), (3, "none")]
    frame, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.digest(decontaminate.marked(frame, bench)).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 70)
    assert sorted(map(tuple, decontaminate.digest(decontaminate.marked(frame, bench)).collect())) == whole
    assert [r[:2] for r in whole] == [(1, 36), (2, len(alnum(rows[1][1]))), (3, 1)]


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_quality_and_toxicity_on_held_out_rows(spark):
    big = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{big}/labels.parquet")
    figures = quality.measured(docs).drop("text").cache()
    got = quality.scored(figures, quality.fit(figures, labels)).join(labels, "doc_id").filter(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).toPandas()
    kept = got["_score"] >= quality.THRESHOLD
    assert (kept == (got["quality"] == 1)).mean() > 0.95 and kept[got["quality"] == 1].mean() > 0.98
    marks = docs.join(labels.select("doc_id", "toxic"), "doc_id")
    got = toxicity.scored(marks, toxicity.fit(docs, labels)).filter(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).toPandas()
    hit = got["_score"] >= 0.5
    assert (hit == (got["toxic"] == 1)).mean() > 0.95


def test_classifiers_on_awkward_rows(spark, awkward):
    labels = spark.createDataFrame([(5, 1, 1), (6, 0, 0), (4, None, None), (99, 1, 0)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for marks in (labels, none):
        rows = quality.scored(quality.measured(awkward), quality.fit(quality.measured(awkward.select("doc_id", "text")).drop("text"), marks)).collect()
        assert len(rows) == len(AWKWARD) and all(0 <= r["_score"] <= 1 for r in rows)
        rows = toxicity.scored(awkward, toxicity.fit(awkward, marks)).collect()
        assert len(rows) == len(AWKWARD) and all(0 <= r["_score"] <= 1 for r in rows)
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.scored(quality.measured(empty), quality.fit(quality.measured(empty), none)).count() == 0
    assert toxicity.scored(empty, toxicity.fit(empty, none)).count() == 0


def test_isotonic():
    assert list(quality.isotonic([(0.0, 1), (1.0, 1), (0.0, 1), (1.0, 1)])) == [0, 0.5, 0.5, 1]


def test_language(spark, awkward):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = language_id.labelled(docs.select("doc_id", "text", "lang"), language_id.fit(docs)).toPandas()
    mine = got[[held(i) for i in got["doc_id"]]]
    assert (mine["_lang"] == mine["lang"]).mean() > 0.98 and mine["_lang_rejected"].mean() < 0.01
    rows = language_id.labelled(awkward, language_id.fit(awkward)).collect()
    assert {r["doc_id"]: r["_lang"] for r in rows if r["doc_id"] in (1, 2, 3, 7)} == dict.fromkeys((1, 2, 3, 7), "und")
    assert all(0 <= r["_lang_score"] <= 1 for r in rows) and language_id.known(awkward).columns == awkward.columns
    empty = spark.createDataFrame([], SCHEMA)
    assert language_id.labelled(empty, language_id.fit(empty)).count() == 0


def test_language_of_copies_keeps_centroids(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE", 20)
    rows = [(i, "der hund und die katze gehen nicht aus", "de") for i in range(2000)] + [(i, f"the dog and cat number {i} go out", "en") for i in range(2000, 2100)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(model["langs"]) == {"de", "en"}


def test_language_ignores_lang_and_source(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs)
    shown = language_id.labelled(docs, model).select("doc_id", "_lang").collect()
    hidden = language_id.labelled(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string")), model).select("doc_id", "_lang").collect()
    assert shown == hidden


PAGE = """<!doctype html><html><head><title>T</title><script>if (a < b) x("</p>")</script></head><body class="no-sidebar">
<header><a href="/">Home</a></header><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav><div class="cookie-notice">We use cookies for all sorts of long reasons.</div>
<div id="wrap"><div class="content"><h1>Title &amp; more</h1><p>First <b>bold<i> text</b> with a <a href="x">link</a>.<br>
second line<p>Next&nbsp;paragraph &lt;3 of words that go on for a while, as text does.<ul><li>item one<li>item two</ul>
<div class="ad-box">Buy now!</div><form><input value=1>Name</form></div>
<aside>Side</aside><section id="comments"><p>Reader says a lot of things about this.</p></section></div><footer>&copy; x</footer></body></html>"""


def test_html(spark):
    want = "Title & more\nFirst bold text with a link. second line\nNext paragraph <3 of words that go on for a while, as text does.\nitem one\nitem two"
    assert html_text.main_text(PAGE) == want
    for html, text in [(None, ""), ("", ""), ("plain a < b text", "plain a < b text"), ("<p>x", "x"), ("<<<>>>", "<<<>>>"), ("<article><p>a</p>\n<p></p></article>", "a"),
                       ("<div" + " <p>deep" * 3000, None), ("<div>" * 5000 + "end", "end"), ("<!-- open", ""), ("<script>never closed", "")]:
        got = html_text.main_text(html)
        assert text is None or got == text, html[:30]
    rows = html_text.extracted(spark.createDataFrame([(1, "u", PAGE, 3), (2, None, None, 4), (None, "u", "<p>é", 5)], "page_id long, url string, html string, text int")).collect()
    assert {(r["page_id"], r["n_chars"]) for r in rows} == {(1, len(want)), (2, 0), (None, 1)}


BODY = "<h1>Title of it</h1><p>" + "Words of text that go on and on. " * 8 + "</p><p>More of the text, as it is.</p>"
BODY_TEXT = "Title of it\n" + "Words of text that go on and on. " * 7 + "Words of text that go on and on.\nMore of the text, as it is."


@pytest.mark.parametrize("name", ["content no-sidebar", "has-sidebar", "with-footer", "widget", "content sidebar"])
def test_html_names_never_take_the_bulk(name):
    assert html_text.main_text(f'<body><div class="{name}">{BODY}</div><footer>f</footer></body>') == BODY_TEXT
    assert html_text.main_text(f'<body><article><div class="{name}">{BODY}<div class="ad">Buy</div></div></article></body>') == BODY_TEXT


def test_html_names():
    page = """<article><h1>T</h1><p>aa bb cc dd</p><section id="related-work"><h2>Related work</h2><p>x</p></section><section id="social-impact"><p>y</p></section>
<h2 id="comments-and-replies">Comments and replies</h2><p>z</p><div class="ad">Buy</div></article><div class="comments"><p>Reader says a lot of things about this.</p></div>"""
    assert html_text.main_text(page) == "T\naa bb cc dd\nRelated work\nx\ny\nComments and replies\nz"
    thirds = f'<div class="widget"><div class="ad">Buy</div>{BODY}</div>' * 3
    assert html_text.main_text(f"<body>{thirds}</body>") == "\n".join([BODY_TEXT] * 3)


@pytest.mark.parametrize("tag", ["form", "aside", "dialog", "menu", "header", "nav", "footer", "object", "canvas"])
def test_html_wrapped(tag):
    controls = "<input value=1><button>Go</button><select><option>One</select><textarea>t</textarea>"
    page = f"<body><{tag}><nav><a href=1>One</a></nav><article>{BODY}{controls}</article><footer>f</footer></{tag}></body>"
    assert html_text.main_text(page) == BODY_TEXT
    if tag in ("form", "aside", "dialog", "menu"):
        assert html_text.main_text(f"<body><{tag}><div>{BODY}</div>{controls}</{tag}><footer>f</footer></body>") == BODY_TEXT
    small = f"<{tag}><p>Some words of a part beside the text.</p></{tag}>"
    assert html_text.main_text(f"<body>{small}<article>{BODY}</article>{small}</body>") == BODY_TEXT
    assert html_text.main_text(f"<body>{small}<div>{BODY}</div>{small}</body>") == BODY_TEXT


LONG = "<p>" + "A very long reader comment that goes on and on. " * 30 + "</p>"
NOISY = [f"<div class='comments'>{LONG}</div>", f"<aside>{LONG}</aside>", f"<form>{LONG}</form>", f"<dialog open>{LONG}</dialog>", f"<div class='cookie-notice'>{LONG}</div>",
         f"<section class='comments'><article>{LONG}</article><article>{LONG}</article></section>"]


@pytest.mark.parametrize("noise", NOISY)
def test_html_long_noise(noise):
    """Reader comments, notices, asides and forms longer than the text go, with and without an article."""
    text = "<h1>Title here</h1><p>First part of the text.</p><p>Second part ends.</p>"
    want = "Title here\nFirst part of the text.\nSecond part ends."
    for page in (f"<article>{text}{noise}</article>", f"<article>{text}</article>{noise}", f"<main>{noise}{text}</main>", f"<div>{text}</div>{noise}", f"{noise}<div>{text}</div>",
                 f"<div class='ad-wrapper'><article>{text}</article></div>{noise}", f"<form id='all'>{text}{noise}</form>"):
        assert html_text.main_text(f"<body>{page}<footer><p>Copyright held.</p></footer></body>") == want, page[:60]


def test_html_comment_articles():
    assert html_text.main_text(f"<article><p>Short one.</p></article><section id='comments'><article>{LONG}</article></section>") == "Short one."
    assert html_text.main_text(f"<div><p>Short one.</p></div><section id='comments'><article>{LONG}</article></section>") == "Short one."
    assert html_text.main_text(f"<article><p>Short one.</p><article class='comment'>{LONG}</article></article>") == "Short one."
    # A wrapper with an unlucky name stays where the title, or all the text, is in it.
    assert html_text.main_text(f"<div class='ad-wrapper'>{BODY}</div><div><p>Copyright held.</p></div>").startswith(BODY_TEXT)
    assert html_text.main_text(f"<div class='comments'>{BODY}</div>") == BODY_TEXT


def test_html_math_and_links():
    links = "".join(f'<li><a href="{i}"><b>Work</b> <i>{i}</i></a></li>' for i in range(4))
    shown = "\n".join(f"Work {i}" for i in range(4))
    page = f"<ul>{links}</ul><article>{BODY}<p>For <math><mi>x</mi><mo>+</mo><mn>1</mn></math>.</p><ol>{links}</ol></article><div>{links}</div>"
    assert html_text.main_text(f"<body>{page}</body>") == f"{BODY_TEXT}\nFor x+1.\n{shown}"
    page = f"<ul>{links}</ul><div>{BODY}<ol>{links}</ol></div>"
    assert html_text.main_text(f"<body>{page}</body>") == f"{BODY_TEXT}\n{shown}"


def test_html_of_the_pages(spark):
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = re.split(r"</?(?:h1|p)>", re.search(r"<article>(.*?)</article>", r["html"], re.S)[1])
        blocks = (" ".join(__import__("html").unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in body)
        assert html_text.main_text(r["html"]) == "\n".join(b for b in blocks if b)


def test_mixing(spark, awkward):
    rows = [(k, " ".join(["w"] * (1 + k % 7)), ["a", "b", "c", None][k % 4] if k % 9 else "a", 0) for k in range(500)] + [(k, "w " * 40, "a", 0) for k in range(500, 700)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string, taken int")).toPandas()
    again = mixing.mixed(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string, taken int")).toPandas()
    assert got.sort_values("doc_id").values.tolist() == again.sort_values("doc_id").values.tolist()
    assert (got["taken"] <= 3 * got["size"]).all() and got["taken"].sum() <= got["size"].sum()
    for (size, target), part in got.groupby(["source_size", "target"]):
        assert target <= 3 * size and abs(part["taken"].sum() - target) <= 45
    odd = {r["doc_id"]: r for r in mixing.mixed(awkward).collect()}
    assert len(odd) == 8 and odd[1]["size"] == odd[1]["taken"] == 0
    assert mixing.mixed(spark.createDataFrame([], SCHEMA)).count() == 0
    assert {r["target"] for r in mixing.mixed(spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")).collect()} == {0.0}


def brute_neighbours(rows, k=20):
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for q, x in fine:
        if q % 20 == 0:
            near = sorted(((-nearest.inner(x[None], y[None])[0], i) for i, y in fine if i != q and len(y) == len(x)))[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


def test_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.normal(0, 1, 8) * (1 + i % 3)]) for i in range(900)]
    rows += [(1000 + i, [1.0] * 8) for i in range(300)] + [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] * 8), (2060, [1.0, None, *[1.0] * 6]), (2080, [1.0, 2.0]), (None, [1.0] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r[0], r[1]) for r in frame.collect()]
    want = brute_neighbours(rows)
    monkeypatch.setattr(nearest, "SHARD_ROWS", 300)
    monkeypatch.setattr(nearest, "QUERY_ROWS", 30)
    usable = nearest.usable(frame)

    def asked(factor):
        got = {}
        for r in nearest.neighbours(usable, usable.filter("id % 20 = 0"), factor=factor).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        return got

    want = {q: v for q, v in want.items() if v}
    assert asked(1.0) == want
    near = asked(nearest.FACTOR)
    assert sum(len({i for i, _ in v} & {i for i, _ in near[q]}) for q, v in want.items()) >= 0.95 * sum(map(len, want.values()))
    assert nearest.neighbours(usable.limit(0), usable.limit(0)).count() == 0


@pytest.mark.parametrize("run,group", [(2048, 512), (3, 2)])
def test_chat(spark, monkeypatch, run, group):
    monkeypatch.setattr(chat_format, "RUN", run)
    monkeypatch.setattr(chat_format, "GROUP", group)
    text = ["System: be brief", "", "User: what is", "it? A: not a marker", "Human > really?", "AI: yes", "", "no", "<|tool|> 42", "[assistant]", "done"]
    lines = spark.createDataFrame([(1, k, x) for k, x in enumerate(text)] + [(2, 0, None), (2, 1, "x")] + [(None, k, f"user: {k}") for k in range(9)], "conv long, no long, line string")
    got = chat_format.turns(lines.withColumn("line", F.coalesce("line", F.lit("")))).orderBy("conv_id", "turn").collect()
    mine = [(r["role"], r["text"]) for r in got if r["conv_id"] == 1]
    assert mine == [("system", "be brief\n"), ("user", "what is\nit? A: not a marker"), ("user", "really?"), ("assistant", "yes\n\nno"), ("tool", "42"), ("assistant", "\ndone")]
    assert [(r["role"], r["text"]) for r in got if r["conv_id"] == 2] == [("user", "\nx")]
    assert [(r["turn"], r["text"]) for r in got if r["conv_id"] is None] == [(k, str(k)) for k in range(9)]
    assert got[-1]["rendered"] == f"<|{got[-1]['role']}|>\n{got[-1]['text']}\n<|end|>"


def test_representatives_lose_no_text(spark):
    """Rows that share an id keep every text that no other row stands for; other columns, maps too, stay as they are."""
    x, y, z = ("alpha beta gamma delta epsilon zeta", "one two three four five six seven", "other words that stand for nothing else at all")
    rows = [(1, x, {"a": 1}), (1, y, {"b": 2}), (2, y, None), (3, z, None), (3, z, None), (4, None, None), (None, y, None), (None, y, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row map<string,int>")
    got = sorted((r["doc_id"] or 0, r["text"] or "", str(r["row"])) for r in jaccard_join.representatives(docs).collect())
    assert got == sorted([(1, x, "{'a': 1}"), (1, y, "{'b': 2}"), (3, z, "None"), (4, "", "None"), (0, y, "None"), (0, y, "None")])
    alone = jaccard_join.representatives(docs.filter("doc_id <> 1 and doc_id <> 3 or text = '" + x + "'")).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in alone) == [(1, x), (2, y), (4, "")]


def test_toxicity_thresholds_count_every_labelled_row(spark, monkeypatch):
    ids = [i for i in range(4000) if fold_of(i) != 0]
    rows = [(i, f"plain words number {i % 50}" if i % 2 else f"vile words number {i % 50}", int(i % 2 == 0)) for i in ids]
    marks = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    seen, plain = [], toxicity._counts
    monkeypatch.setattr(toxicity, "_counts", lambda *a: seen.append(plain(*a)) or seen[-1])
    monkeypatch.setattr(toxicity, "SAMPLE", 100)
    model = toxicity.fit(docs, marks)
    kept_back = [y for i, _, y in rows if fold_of(i) == 4]
    assert seen[0][:, 2].sum() == kept_back.count(0) and seen[0][:, 3].sum() == kept_back.count(1)
    got = toxicity.scored(docs, model).join(marks, "doc_id").toPandas()
    assert ((got["_score"] >= 0.5) == (got["toxic"] == 1)).mean() > 0.95


def fold_of(i):
    return zlib.crc32(str(i).encode()) % 5
