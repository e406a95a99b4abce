"""HTML extraction, chat perspectives and top-k search against what they should give."""

import re
import time
from html import unescape

import duckdb
import numpy as np
import pytest

from tabularium.llm import chat, html_extract, topk

PAGE = "<html><head><title>T</title></head><body><nav><a href=/>Home</a></nav><article><h1>Head &amp; tail</h1>{}</article><footer>foot</footer></body></html>"


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<p>One  two\n three</p><p>Four <b>five</b>six</p>", "One two three\n\nFour fivesix"),
        ("<p>One<p>Two<br>three", "One\n\nTwo three"),
        ("<p>One</p><script>if (a < b) { document.write('<p>no</p>') }</script><p>Two</p>", "One\n\nTwo"),
        ("<p>One</p><!-- <p>no</p> --><div class='ad'>Buy this now</div><p>Two &eacute;&#233;&#xe9;</p>", "One\n\nTwo ééé"),
        ("<p>One</p><aside><p>side bar words</p></aside><form><p>name</p><input></form><p>Two</p>", "One\n\nTwo"),
        ("<ul><li>first point<li>second point</ul>", "first point\n\nsecond point"),
        ("<p>a < b and c</p>", "a < b and c"),
        ("<p>Some <a href='/x'>linked words</a> inside</p>", "Some linked words inside"),
        ("<p>Shown</p><p style='display:none'>hidden text</p><div id='comments'><p>first!</p></div>", "Shown"),
    ],
)
def test_blocks(body, want):
    assert html_extract.main_text(PAGE.format(body)) == "Head & tail\n\n" + want


KEPT = [
    '<div class="overflow-hidden"><p>{}</p></div>', '<div style="overflow:hidden"><p>{}</p></div>', '<p aria-hidden="false">{}</p>', '<p><a href="/hidden-valley">{}</a></p>', '<p title="the hidden door">{}</p>',
    '<section id="related-work"><p>{}</p></section>', '<div class="topic-social"><p>{}</p></div>', '<p data-id="ad">{}</p>',
]
GONE = [
    '<div class="comment-list"><p>{}</p></div>', "<div hidden><p>{}</p></div>", '<p aria-hidden="true">{}</p>', '<div id="user-comments"><p>{}</p></div>', '<div class="x adBanner"><p>{}</p></div>',
    '<p style="color:red; display : none">{}</p>', '<div role="navigation"><p>{}</p></div>',
]


@pytest.mark.parametrize("part", [*KEPT, *GONE])
def test_names_and_attributes_count_as_wholes(part):
    words = "these are the words in question and there are enough of them"
    body = "<p>Some first words of it, before anything else.</p>" + part.format(words) + "<p>Some more words, to end with.</p>"
    assert (words in html_extract.main_text(PAGE.format(body))) == (part in KEPT)
    if part in KEPT:  # without an article element too
        more = "<p>" + "plain words of the story that goes on " * 10 + "</p>"
        assert words in html_extract.main_text(PAGE.replace("article>", "div>").format(more + part.format(words) + more))


def test_text_under_a_name_alone():
    assert html_extract.main_text("<body><div class='widget'><p>all the text there is</p></div></body>") == "all the text there is"


@pytest.mark.parametrize("part", ["<b>" * 10 + "</x>" * 10, "<a ", '<a b="', "<a b='>", "<", "<!--", "<p>", "</x ", "<select></select"])
def test_broken_pages_take_linear_time(part):
    def seconds(size):
        start = time.process_time()
        html_extract.main_text(part * (size // len(part)))
        return time.process_time() - start

    assert seconds(400_000) < 8 * seconds(100_000) + 0.3


def test_page_without_markup_of_its_parts():
    menu = "".join(f"<a href='/{k}'>Menu {k}</a> " for k in range(12))
    body = "<div><h1>A title of some words</h1><p>" + "plain words of the story " * 20 + "</p><p>The end of it.</p></div>"
    text = html_extract.main_text(f"<html><body><div>{menu}</div>{body}<table><tr><td>{menu}</td></tr></table></body></html>")
    assert text.startswith("A title of some words\n\nplain words") and text.endswith("The end of it.") and "Menu" not in text


def test_best_region_against_all_runs():
    rng = np.random.default_rng(3)
    for _ in range(200):
        x = rng.integers(-5, 6, rng.integers(0, 12)).tolist()
        a, b = html_extract.best_region(x)
        assert sum(x[a:b]) == max([0, *(sum(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1))])


def test_pages_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: r for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = (" ".join(unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article))
        want = "\n\n".join(b for b in blocks if b)
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"], got[r["page_id"]]["url"]) == (want, len(want), r["url"])


def test_odd_pages(spark):
    rows = [(1, None, None, "x"), (2, "u", "", "x"), (3, "u", "<html></html>", "x"), (4, "u", "just text", "x"), (5, "u", "<p>" + "long words " * 50_000, "x"), (None, "u", "<script>", "x")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 9), (5, 549_999)]
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


ROWS = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hi"), (1, 2, "assistant", "Hello é"), (1, 3, "ann", None),
    (2, 0, "user", "only me"), (2, 600, "user", "later part"), (3, 0, "system", "alone"), (4, None, None, "who"), (4, 1, "user", ""), (4, 1, "user", ""), (None, 0, "bob", "no conversation"),
]
TURNS = "conv_id long, turn long, role string, text string"


def test_perspectives(spark):
    got = {(r["conv_id"], r["speaker"], r["part"]): r for r in chat.perspectives(spark.createDataFrame(ROWS, TURNS)).collect()}
    assert set(got) == {(1, "user", 0), (1, "assistant", 0), (1, "ann", 0), (2, "user", 0), (2, "user", 1), (4, "unknown", 0), (4, "user", 0), (None, "bob", 0)}
    r = got[1, "assistant", 0]
    assert r["text"] == "<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>user name=user\nHi<|im_end|>\n<|im_start|>assistant\nHello é<|im_end|>\n<|im_start|>user name=ann\n<|im_end|>\n"
    runs = [tuple(map(int, x.split(":"))) for x in r["mask"].split(",")]
    assert sum(n for _, n in runs) == len(r["text"])
    at, trained = 0, ""
    for own, n in runs:
        trained += r["text"][at : at + n] * own
        at += n
    assert trained == "Hello é" and (r["n_turns"], r["n_trained"]) == (4, 1)


def test_perspectives_sql(spark):
    frame = spark.createDataFrame(ROWS, TURNS)
    con = duckdb.connect()
    con.register("conversations", frame.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    want = con.execute(f"SELECT conv_id, speaker, part, n_turns, n_trained, text, mask FROM ({chat.PERSPECTIVES_SQL})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in chat.perspectives(frame).collect())
    assert chat.perspectives(spark.createDataFrame([], TURNS + ", m string, part int")).collect() == []


def brute_top(rows, k):
    vectors = sorted({(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)})
    whole = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in vectors]
    out = []
    for i, v in whole:
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in whole if j != i and len(w) == len(v))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=4).round(1).tolist()) for k in range(0, 700)]
    rows += [(1000 + k, [0.5, 0.5, 0.5, 0.5]) for k in range(40)] + [(2000, None), (2050, [1.0, None, 0.0, 0.0]), (2100, [float("nan")] * 4), (2150, [float("inf")] * 4), (2200, [1.0, 2.0]), (2201, [3.0, -1.0]), (2250, []), (0, rows[0][1]), (None, [1.0] * 4)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(topk.quantised(frame.selectExpr("*", "1 as score", "2 as v")), "vec_id % 50 = 0", 5)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 5)


def test_top_k_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "DATA_BLOCK", 90)
    rng = np.random.default_rng(6)
    rows = [(k, (rng.normal(size=8) + 3 * (k % 5)).tolist()) for k in range(400)]
    got = topk.top_k(topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>")), "vec_id % 50 = 0", 5)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 5)


@pytest.mark.parametrize("spread", [0.0, 60.0])
def test_top_k_across_cells(spark, monkeypatch, spread):
    """Cells of unlike size with several parts, vectors of two lengths, one vector that a third of all rows share."""
    for name, value in (("QUERY_BLOCK", 3), ("DATA_BLOCK", 50), ("CELL_ROWS", 25), ("SAMPLE", 200)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(8)
    axes = np.concatenate([np.eye(6), -np.eye(6)])
    rows = [(k, (rng.normal(size=6) + spread * axes[k % 12]).tolist()) for k in range(400)]
    rows += [(400 + k, [0.5] * 6) for k in range(200)] + [(600 + 10 * k, [float(k), 1.0]) for k in range(30)] + [(950, [2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    met = []
    monkeypatch.setattr(topk, "written", lambda df, name, f=topk.written: met.append((name, f(df, name))) or met[-1][1])
    monkeypatch.setattr(topk, "remove", lambda df: None)
    got = topk.top_k(topk.quantised(frame), "vec_id % 50 = 0", 5)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 5)
    made = dict(met)
    groups, parts = made["queries"].select("dim", "q_cell", "q_part").distinct(), made["cells"].groupBy("dim").sum("parts")
    all_pairs = groups.join(parts, "dim").groupBy().sum("sum(parts)").collect()[0][0] - groups.count()
    assert made["cells"].count() > 5 and (made["visits"].count() < 0.7 * all_pairs if spread else made["visits"].count() <= all_pairs)


def test_pruning_skips_far_clusters():
    rng = np.random.default_rng(7)
    vectors = np.concatenate([rng.integers(-3, 4, (300, 6)) + np.array([k * 200] + [0] * 5) for k in range(6)])
    q = np.arange(4)
    _, ids, scores = topk.search(q, vectors[-4:], np.arange(len(vectors)), vectors, 2)
    best = np.sort(vectors[-4:] @ vectors.T, 1)[:, ::-1][:, :2]
    assert (scores.reshape(4, 2) == best).all()


def test_no_vectors(spark):
    assert topk.top_k(topk.quantised(spark.createDataFrame([], "vec_id long, embedding array<float>")), "vec_id % 50 = 0", 5).collect() == []
