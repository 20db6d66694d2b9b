"""Blocks of a page by hand, gradients of the network, and held-out pages."""

import random

import numpy as np
import pytest
from helpers import SF_DIR, rows_of

from tallyframe.llm import html_extract as he
from tallyframe.llm.html_blocks import blocks

SCHEMA = "page_id long, url string, html string"


@pytest.mark.parametrize(
    "html, texts",
    [
        (None, []),
        ("", []),
        ("  plain  text ", ["plain text"]),
        ("<p>one<p>two <b>bold\n\t x</b>y</p>z", ["one", "two bold xy", "z"]),
        ("a &amp; b &eacute;&#x41; &copy &lt;p&gt;", ["a & b éA © <p>"]),
        ("<p>a<br>b<br/>c", ["a b c"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
        ("<script>var t='</p><p>x';</script><style>p{}</style><p>y", ["y"]),
        ("<SCRIPT src='x>y'>if (a<b) c</SCRIPT >z", ["z"]),
        ("<script>never closed <p>x", []),
        ("<!-- <p>no</p> --><p>yes<!-- cut", ["yes"]),
        ("<title>t &amp; u</title><h1>h</h1>", ["h"]),
        ('<p title="a>b" class=\'c>d\'>x</p>', ["x"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]),
        ("1 < 2 and 3 > 2", ["1 < 2 and 3 > 2"]),
        ("<p>cut <b>off</b> <foo", ["cut off"]),
        ("<p>cut off</foot", ["cut off"]),
        ("<b><p>x</b>y</p>", ["xy"]),
        ("<textarea><p>no</textarea><select><option>o</select>t", ["o", "t"]),
        ("<p " + "x" * 100_000, []),
        ('<p a="' + "<p>" * 20_000, []),
    ],
)
def test_blocks(html, texts):
    assert [b.text for b in blocks(html)] == texts


@pytest.mark.parametrize(
    "html, texts",
    [
        ("<p>if <math><mi>x</mi><mo>=</mo><mn>2</mn></math> then</p>", ["if x=2 then"]),
        ("<p>a<xmp><b>x</b> &amp; if a<b</xmp>z", ["a", "<b>x</b> &amp; if a<b", "z"]),
        ("<xmp>open <b>bold</b><p>rest", ["open bold", "rest"]),
        ("<object data=x><param name=y><p>instead of it</p></object>z", ["instead of it", "z"]),
        ("<object data=x><div><article><p>text</p></article></div>", ["text"]),
        ("<p>a <svg><title>Icon</title><style>p{}</style><path d='M0'/><text>label</text></svg> b</p>c", ["a Iconlabel b", "c"]),
        ("<svg><title>Icon</svg><p>text</p>", ["Icon", "text"]),
        ("<div><svg><path d='M0'><article><p>text</p></article></div>z", ["text", "z"]),
        ("<title>t</title><svg><path d='M0'></svg><title>u</title>x", ["x"]),
        ("<svg><foreignObject><div>in it</div></foreignObject><text>on</text></svg>", ["in it", "on"]),
    ],
)
def test_blocks_of_formulas_drawings_and_objects(html, texts):
    assert [b.text for b in blocks(html)] == texts


def test_an_open_drawing_is_not_in_the_path_of_what_follows():
    assert [[e.tag for e in b.path] for b in blocks("<div><svg><path d='M0'><article><p>text")] == [["div", "article", "p"]]


def test_all_words_of_a_class_count():
    names = " ".join(f"name{'abcdefghijklmnopqrstuvwxyz'[i]}" for i in range(26))
    assert {"namea", "namez", "div.namez"} <= set(blocks(f'<div class="{names}">x')[0].path[0].tokens)


def test_paths_and_links():
    page = blocks('<body><div class="site-Nav" id=top><a href=x>go</a> on</div><p>t</p><div>u<p>v</div>w')
    assert [[e.tag for e in b.path] for b in page] == [["body", "div"], ["body", "p"], ["body", "div"], ["body", "div", "p"], ["body"]]
    assert {"div.site", "nav", "top"} <= set(page[0].path[-1].tokens) and page[0].link_chars == 2


def test_gradients_are_those_of_the_loss():
    rng = random.Random(1)
    pages = [blocks(he.rebuilt(["Some text here.", "More of the same text."], ["noise words here now"], rng)) for _ in range(3)]
    labels = np.concatenate([he.marked(p) for p in pages])
    packed, model = he.Vectoriser()(pages), he.Labeller.fresh()
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}

    def loss():
        odds, _ = model.run(packed)
        return float(np.mean(np.logaddexp(0, odds) - labels * odds))

    gradients = model.gradients(packed, labels)
    r = np.random.default_rng(2)
    for name, g in gradients.items():
        flat = np.argsort(-np.abs(g).ravel())[:40]
        for place in r.choice(flat, 4):
            at, step = np.unravel_index(place, g.shape), 3e-3
            kept = model.w[name][at]
            model.w[name][at] = kept + step
            up = loss()
            model.w[name][at] = kept - step
            down = loss()
            model.w[name][at] = kept
            assert (up - down) / (2 * step) == pytest.approx(float(g[at]), rel=0.05, abs=2e-5), name


@pytest.fixture(scope="module")
def sample(spark):
    rows = spark.read.parquet(f"{SF_DIR.replace('0.001', '0.01')}/pages.parquet").orderBy("page_id").select("html").collect()
    return [r["html"] for r in rows]


@pytest.fixture(scope="module")
def labeller(sample):
    return he.train(sample[:120])


def test_held_out_pages(labeller, sample):
    pages = [blocks(h) for h in sample[120:]]
    want = ["\n".join(b.text for b, y in zip(p, he.named_main(p)) if y) for p in pages]
    got = labeller.main_text(pages, he.Vectoriser())
    assert np.mean([a == b for a, b in zip(got, want)]) >= 0.98


def test_held_out_rebuilt_pages(labeller, sample):
    rng = random.Random(5)
    texts = [[b.text for b, y in zip(p, he.named_main(p)) if y] for p in (blocks(h) for h in sample[120:])]
    others = [t for p in texts for t in p]
    right = total = 0
    for paragraphs in filter(None, texts):
        page = blocks(he.rebuilt(paragraphs[:20], others, rng))
        odds, _ = labeller.run(he.Vectoriser()([page]))
        right += ((odds > 0) == he.marked(page)).sum()
        total += len(page)
    assert right / total >= 0.97


def test_results_do_not_depend_on_the_batch(labeller, sample):
    pages = [blocks(h) for h in sample[:40]]
    together = labeller.main_text(pages, he.Vectoriser())
    assert together == [labeller.main_text([p], he.Vectoriser())[0] for p in pages]


def test_awkward_pages(spark, labeller):
    long = "<article>" + "<p>word one two three.</p>" * 20_000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<script>x</script>"), (4, "u", long), (None, "u", "<article><p>Text is here.</p></article>")]
    got = he.main_texts(spark.createDataFrame(rows, SCHEMA), labeller)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    out = {r["page_id"]: (r["text"], r["n_chars"]) for r in got.collect()}
    assert out[1] == out[2] == out[3] == ("", 0)
    assert out[None][1] == len(out[None][0]) and out[4][0].count("\n") > 15_000
    assert he.main_texts(spark.createDataFrame([], SCHEMA), labeller).count() == 0
    untrained = he.train([])
    assert untrained.main_text([[], blocks("<p>x")], he.Vectoriser())[0] == ""


def test_large_pages_are_in_the_sample(spark, monkeypatch):
    monkeypatch.setattr(he, "train", lambda sample, window_blocks: (sample, window_blocks))
    rows = [(i, "u", f"<article><p>{i} {'many words ' * 4000}</p></article>") for i in range(6)]
    pages = spark.createDataFrame([*rows, rows[0], (9, "u", None)], SCHEMA)
    sample, window = he.fit(pages)
    assert sorted(sample) == sorted(h for _, _, h in rows) and window == he.WINDOW_BLOCKS
    assert he.fit(pages, sample_pages=4)[0] == sample[:4]
    assert he.fit(pages, sample_bytes=100_000, window_blocks=7) == (sample[:2], 7)
    assert he.fit(pages, sample_bytes=1)[0] == sample[:1]
    assert he.fit(pages.limit(0))[0] == []


def test_windows_hold_the_start_and_the_end():
    page, labels = list(range(500)), np.arange(500) % 2 == 0
    parts = he.windows(page, labels, 120, random.Random(1))
    assert [len(p) for p, _ in parts] == [120] * 3 and parts[0][0][0] == 0 and parts[-1][0][-1] == 499
    assert all((labels[p] == y).all() for p, y in parts)
    assert he.windows(page[:120], labels[:120], 120, random.Random(1))[0][0] == page[:120]


def test_query(spark):
    from tallyframe.llm.queries import op4_html_extraction

    rows = rows_of(op4_html_extraction(spark, SF_DIR), "page_id", "n_chars")
    assert len(rows) == spark.read.parquet(f"{SF_DIR}/pages.parquet").count() and all(n > 0 for _, n in rows)
