"""Pages in forms that HTML allows and the given tables do not have."""

import time

import numpy as np
import pytest

from panelsmith.llm import html


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>x</title><article><p>Hello",
        "<html><head><meta charset=utf-8><style>a</style><script>b</script><article><p>Hello</article>",
        "<head><title>x</title><link rel=a>Hello",
        "<head><title>x</title></head><body><p>Hello",
        "<html><head><title>x</title><body><p>Hello",
        "<head>\n <noscript><img src=a>x</noscript><template><p>y</p></template>\n<span>Hello</span>",
    ],
)
def test_head_without_end_tag(page):
    assert [b[1] for b in html.blocks(page)] == ["Hello"]


def test_math_and_fallback_text_stay():
    page = "<body><article><p>a <math><mi>x</mi><mo>=</mo><mn>2</mn></math> b<object data=u><p>fallback</object><svg><text>no</text></svg></article>"
    assert [b[1] for b in html.blocks(page)] == ["a x=2 b", "fallback"]


def test_all_class_and_id_words_count():
    path = html.blocks("<div class='flex mt-4 p-2 bg-gray text-sm' id='comments'>Reply</div>")[0][0]
    assert path == "div.flex.mt.4.p.2.bg.gray.text.sm.comments"
    assert html._path_slots(path) > () and html.crc32(b"comments") % html.PATH_SLOTS in html._path_slots(path)


P = "The council met on Monday and agreed on a plan for the old bridge, which has been closed since spring."
Q = "Work will begin in June. Two lanes stay open, and the path along the river is moved for a year."
R = "Nobody was hurt when the first stones fell, said the mayor; the cause is not known."
NAV = "<nav><ul><li><a href=/>Home</a></li><li><a href=/news>News</a></li><li><a href=/about>About us</a></li></ul></nav>"
FOOT = "<footer><p>Copyright 2021 All rights reserved</p></footer>"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<div><div><h1>A new bridge</h1><p>{P}</p><p>{Q}</p><p>{R}</p></div></div>", ["A new bridge", P, Q, R]),
        (f"<body>{NAV}<div class='row mt-4'><div class=col><h1>A new bridge</h1><p>{P}</p><p>{Q}</p></div></div>{FOOT}", ["A new bridge", P, Q]),
        (
            f"<body>{NAV}<article><h1>A new bridge</h1><p>{P}</p><table><tr><th>Year</th><th>Sum</th></tr><tr><td>1999</td><td>12</td></tr></table><pre>x = 1;\ny = 2;</pre>"
            f"<dl><dt>Span</dt><dd>The way between two piers</dd></dl><figure><img src=a><figcaption>The bridge in winter.</figcaption></figure><p>{Q}</p></article>{FOOT}",
            ["A new bridge", P, "Year", "Sum", "1999", "12", "x = 1; y = 2;", "Span", "The way between two piers", "The bridge in winter.", Q],
        ),
        (f"<head><title>t</title><body>{NAV}<main><h1>A new bridge</h1><p>{P}<p>{Q}<p>{R}</main><aside><h3>Related</h3><ul><li><a href=/1>Older news</a></ul></aside>{FOOT}", ["A new bridge", P, Q, R]),
        (f"<body><header><a href=/>Daily Site</a></header>{NAV}<section class=story><h2>A new bridge</h2><p>{P}</p><ul><li>Two lanes stay open</li><li>The path moves</li></ul></section>{FOOT}", ["A new bridge", P, "Two lanes stay open", "The path moves"]),
        (f"<body>{NAV}<article><h1>A new bridge</h1><p>{P}</p><div class=ad>Buy now, only today</div><p>{Q}</p></article><section id=comments><h3>Comments</h3><p>Great, I agree with every word of it.</p></section>{FOOT}", ["A new bridge", P, Q]),
        (f"<body>{NAV}<div id=content><h1>A new bridge</h1><blockquote><p>{R}</p></blockquote><p>{P}</p></div><form class=newsletter><label>Email</label><button>Subscribe</button></form>{FOOT}", ["A new bridge", R, P]),
        (f"<body><div class=cookie-notice><p>We use cookies. By continuing you agree.</p></div>{NAV}<article><h1>A new bridge</h1><section><h2>Why</h2><p>{P}</p></section><section><h2>When</h2><p>{Q}</p></section></article>{FOOT}", ["A new bridge", "Why", P, "When", Q]),
        (f"<body>{NAV}<article><h1>A new bridge</h1><p>{P} <select><option>One<option>Two<p>{Q}</article>{FOOT}", ["A new bridge", P, Q]),
        (f"<body>{NAV}<article><h1>A new bridge</h1><noscript><p>{P}</p><p>{Q}</p></article>{FOOT}", ["A new bridge", P, Q]),
        (f"<title>t<body><article><h1>A new bridge</h1><p>{P}</p></article>{FOOT}", ["A new bridge", P]),
        (f"<body>{NAV}<article><h1>A new bridge</h1><p>{'<i>' * 14}{P}<p>{Q}</article>{FOOT}", ["A new bridge", P, Q]),
    ],
)
def test_main_text_of_written_pages(page, want):
    """Layouts that the labeller was not trained on: the expected text was written by hand."""
    found = html.blocks(page)
    assert html.main_text(found, html.trained().label([found])[0]).split("\n") == want


def test_list_items_and_cells_close_each_other():
    paths = [b[0] for b in html.blocks("<ul><li><p>a<li>b<ul><li>c</ul></ul><table><tr><td>d<td>e<tr><td>f</table><dl><dt>g<dd>h<dt>i</dl>")]
    assert paths == ["ul/li/p", "ul/li", "ul/li/ul/li", "table/tr/td", "table/tr/td", "table/tr/td", "dl/dt", "dl/dd", "dl/dt"]


@pytest.mark.parametrize("name", "field-item mw-parser-output hentry c-article__body prose td-post-content wysiwyg storytext body__inner StoryBody caas-body".split())
@pytest.mark.parametrize("top", ["<h1>A new bridge</h1>", "<div class=top><h1 class=entry-title>A new bridge</h1><span class=byline>By Ann Lee</span></div>", "<h1>A new bridge</h1><h3>Why</h3>"])
def test_container_names_that_training_does_not_have(name, top):
    found = html.blocks(f'<body class="single single-post">{NAV}<div class="{name}">{top}<p>{P}</p><p>{Q}</p><p>{R}</p></div>{FOOT}')
    kept = html.main_text(found, html.trained().label([found])[0]).split("\n")
    assert [x for x in kept if x != "By Ann Lee"] == ["A new bridge", *(["Why"] if "<h3" in top else []), P, Q, R]


def test_paths_are_bounded_and_keep_their_slots():
    """Words of tags that a path leaves out have no slot of their own."""
    rng = np.random.default_rng(1)
    opened = [(str(rng.choice(["div", "p", "section", "span"])), " ".join(f"n{k}" for k in rng.integers(0, 40, 3))) for _ in range(60)]
    page = "".join(f"<{tag if tag != 'p' else 'div'} class='{names}'>" for tag, names in opened) + "word"
    whole = "/".join(".".join([tag if tag != "p" else "div", *names.split()]) for tag, names in opened)
    (path, *_), *rest = html.blocks(page)
    assert not rest and len(path) < len(whole) and html._path_slots(path) == html._path_slots(whole)
    start = time.monotonic()
    found = html.blocks("<div>word " * 90_000)
    assert len(found) == 90_000 and max(len(b[0]) for b in found) < 40
    assert len(html.trained().label([found])[0]) == len(found) and time.monotonic() - start < 60


def test_states_follow_from_the_step_by_step_pass():
    model = html.Labeller(3)
    pages = [html.blocks(f"<body>{NAV}<article><p>{P}</p></article>{FOOT}"), html.blocks(f"<p>{Q}"), html.blocks(f"<ul><li>{R}<li>a<li>b</ul>")]
    got = model.logits(pages)
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    for col, found in enumerate(pages):
        x = np.concatenate([html.path_vectors([b[0] for b in found]), html.vectors(found)], axis=1).astype(float)
        states = {}
        for d, order in (("f", range(len(x))), ("b", range(len(x) - 1, -1, -1))):
            h, c = np.zeros(html.HIDDEN), np.zeros(html.HIDDEN)
            for t in order:
                i, f, o, g = np.split(x[t] @ model.p[f"x{d}"] + h @ model.p[f"h{d}"] + model.p[f"c{d}"], 4)
                c = sigmoid(f) * c + sigmoid(i) * np.tanh(g)
                h = sigmoid(o) * np.tanh(c)
                states[d, t] = h
        want = [np.concatenate([states["f", t], states["b", t]]) @ model.p["o"][:, 0] + model.p["ob"][0] for t in range(len(x))]
        assert np.allclose(got[: len(x), col], want, atol=1e-4)


def test_empty_table(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert html.extract_pages(none).collect() == []
