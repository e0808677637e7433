import random
import re
import time
from html import unescape

import pytest

from weftline.llm import blocktext, queries
from weftline.llm.blocktext import between, extract, lines, main_text

SF = "/root/testdata/sf0.001"

ARTICLE = "<p>First paragraph of the story, long enough to count as text.</p><p>Second one.</p>"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""), ("", ""), ("   ", ""), ("plain &amp; simple", "plain & simple"), ("a < b and c &gt; d", "a < b and c > d"),
        (f"<nav><a href=/>Home</a></nav><article><h1>T</h1>{ARTICLE}</article><footer>(c)</footer>", "T\n\nFirst paragraph of the story, long enough to count as text.\n\nSecond one."),
        ("<article><h1>T</h1><p><b>one\n two<br>three&nbsp;&eacute;<p>four</article><footer>x", "T\n\none two three é\n\nfour"),
        ("<head><title>t</title><style>p{}</style><script>var a='</p>';</script></head><body><main>x<!-- <p>no</p> -->y</main>", "xy"),
        ("<article><p>a</p><div class='ad-box'>buy</div><aside>s</aside><p>b</p><form><p>f</p></form><div id=comments><p>c</p></div></article>", "a\n\nb"),
        ("<article><header><h1>T</h1></header><p>x</p></article><header>site</header>", "T\n\nx"),
        ("<div class='cookie-notice'>ok?</div><div role=navigation>m</div><div hidden>h</div><p>text</p>", "text"),
        ("<ul><li><a href=1>One</a><li><a href=2>Two</a></ul><div>" + ARTICLE + "</div><ul><li><a href=3>Three</a></ul>", "First paragraph of the story, long enough to count as text.\n\nSecond one."),
        ("<p title='a > b'>in</p>", "in"), ("<p title='a hidden ad class=ad'>kept</p><p data-x=hidden>too</p><p HIDDEN>no</p>", "kept\n\ntoo"), ("<article><div class=article-header><h1>T</h1></div><p>x</p></article>", "T\n\nx"), ("<p>x<script>y", "x"), ("<table><tr><td>a<td>b</table>", "a\n\nb"),
    ],
)
def test_extract(html, want):
    assert extract(html) == want


def test_markup_leaves_empty_lines():
    """One where boxes begin or end, three around noise, whose lines stay in the distribution without weight."""
    assert [(t, n) for t, n, _ in lines("<p>a</p><nav>n</nav><div><p>b</p></div>")] == [("a", 1), *[("", 0)] * 3, ("n", 0), *[("", 0)] * 3, ("b", 1), ("", 0)]
    assert [t for t, _, _ in lines("<div><div><div>a</div></div></div><div><div>b</div></div>")] == ["", "a", "", "b", ""]


def brute_between(found, window, part):
    """The distribution by its definition, sum by sum."""
    n = len(found)
    weight = lambda i: found[i][1] if 0 <= i < n else 0
    cover = lambda i: [j for j in range(i - window + 1, i + 1) if 0 <= j < n]
    sums = [sum(weight(j) for j in cover(i)) for i in range(n + window - 1)]
    top = max(sums, default=0)
    keep, run = set(), []
    for i in [*range(len(sums)), None]:
        if i is not None and sums[i] > 0:
            run.append(i)
            continue
        if any(part * sums[j] >= top for j in run):
            some = [j for j in range(n) if weight(j) and j in run]
            keep.update(range(some[0], some[-1] + 1))
            for step, j in ((-1, some[0]), (1, some[-1])):
                for k in range(1, window):
                    if not (0 <= j + step * k < n and found[j + step * k][0]):
                        break
                    keep.add(j + step * k)
        run = []
    for a in {x[2] for x in found} - {0}:
        own = [j for j in range(n) if found[j][2] == a]
        if not top or any(part * sums[i] >= top and weight(j) for j in own for i in range(j, j + window)):
            keep.update(own)
    return [j in keep for j in range(n)]


@pytest.mark.parametrize("window", [1, 2, 3, 5])
def test_distribution_equals_brute_force(window):
    rng = random.Random(window)
    for _ in range(400):
        found, article = [], 0
        for _ in range(rng.randrange(1, 40)):
            kind = rng.random()
            article = rng.choice([0, 1, 2]) if rng.random() < 0.1 else article
            found += [("", 0, 0)] * rng.randrange(1, 5) if kind < 0.3 else [("x", 0 if kind < 0.45 else rng.choice([1, 5, 20, 300]), article)]
        part = rng.choice([1, 3, 5])
        assert between(found, window, part).tolist() == brute_between(found, window, part)
    assert between([]).tolist() == []


def test_distribution_decides_on_unnamed_parts(monkeypatch):
    """Without any list of names, the menu has no weight and neither the advert nor the footer surges."""
    body = "".join(f"<p>{'word ' * 60}</p>" for _ in range(4))
    menu = "<ul><li><a href=/>Home</a><li><a href=/x>News</a><li><a href=/y>Sport</a></ul>"
    page = f"{menu}<div>Buy this now</div>{menu}<div><h1>Title</h1>{body}</div>{menu}<div>All rights reserved by us</div>"
    want = "\n\n".join(["Title", *[("word " * 60).strip()] * 4])
    assert extract(page) == want
    for name in ("_NOISE", "_SKIP", "_ROLES"):
        monkeypatch.setattr(blocktext, name, frozenset())
    assert extract(page) == want


def pages(spark):
    return [(r.page_id, r.html or "") for r in queries.table(spark, SF, "pages").collect()]


def test_query_equals_brute_force(spark):
    """The pages of the test tables have one article each, of headings and paragraphs, and nothing else in it."""
    want = {}
    for i, html in pages(spark):
        inner = re.search(r"(?s)<article>(.*)</article>", html)[1]
        blocks = (" ".join(unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", x))).split()) for x in re.split(r"</?(?:p|h1)>", inner))
        want[i] = "\n\n".join(x for x in blocks if x)
    got = queries.op5_main_text(spark, SF).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_the_method_decides_on_the_test_pages(spark, monkeypatch):
    """Every page changes without the distribution; nine of ten stay as they are without any list of names, and all without the rule for articles."""
    html = [h for _, h in pages(spark)]
    want = [extract(h) for h in html]
    assert all("\n\n".join(t for t, _, _ in lines(h) if t) != w for h, w in zip(html, want, strict=True))
    for h, w in zip(html, want, strict=True):
        plain = [(t, n, 0) for t, n, _ in lines(h)]
        assert "\n\n".join(t for (t, _, _), k in zip(plain, between(plain), strict=True) if k and t) == w
    monkeypatch.setattr(blocktext, "_NOISE", frozenset())
    monkeypatch.setattr(blocktext, "_SKIP", frozenset(["head"]))
    assert sum(extract(h) == w for h, w in zip(html, want, strict=True)) >= 0.85 * len(html)


@pytest.mark.parametrize(("name", "noise"), [("ad-box", True), ("ad-hoc-analysis", False), ("cookie-notice", True), ("site-footer", True), ("tags", False), ("legal-text", False), ("related", False), ("share", False), ("header-image", False), ("comments-area", True), ("comment-on-the-law", False), ("mainNav", True), ("ad2", True)])
def test_classes(name, noise):
    assert extract(f'<div class="{name}">{ARTICLE}</div><p>x</p>').startswith("First") != noise


@pytest.mark.parametrize("html", ["<a " * 50_000, '<a b="' * 50_000, "<!--" * 50_000, "<div>" * 20_000, "<script>" * 20_000, "&" * 200_000, "<p>x" * 20_000, "</p>" * 50_000])
def test_long_and_broken_pages_end(html):
    assert isinstance(extract(html), str)


def test_long_text_is_whole():
    assert len(extract("<article><p>" + "word " * 400_000 + "</p></article>")) == 5 * 400_000 - 1


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", f"<article>{ARTICLE}</article>", "x"), (1, None, None, "x"), (None, "u", "<p>é</p>", "x"), (1, "u", "<p>é</p>", "x")], "page_id long, url string, html string, text string")
    out = main_text(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.n_chars) for r in out.collect()) == [(0, 1), (1, 0), (1, 1), (1, 72)]
    assert main_text(df.limit(0)).count() == 0


TEXT = "First paragraph of the story, long enough to count as text.\n\nSecond one."


@pytest.mark.parametrize("start", ['<svg class="i"/>', "<math/>", "<video src=x>", "<object data=x>", "<canvas>"])
def test_text_after_empty_or_unclosed_elements_stays(start):
    assert extract(f"<article>{start}{ARTICLE}</article>") == TEXT


def test_raw_text_still_runs_to_the_end():
    assert extract(f"<article>{ARTICLE}</article><script>{ARTICLE}") == TEXT
    assert extract(f"<article>{ARTICLE}<svg><text>x</text></svg></article>") == TEXT
    assert isinstance(extract("<video>" * 50_000), str)


@pytest.mark.parametrize("name", ["has-sidebar", "with-sidebar", "no-footer", "page-with-left-sidebar"])
def test_wrappers_that_have_noise_are_not_noise(name):
    assert extract(f'<div class="{name}">{ARTICLE}</div>') == TEXT
    assert extract(f'<div class="left-sidebar">{ARTICLE}</div>') == ""


def test_nested_boxes_lose_nothing():
    """How deep boxes nest is no distance: a short last paragraph in boxes of its own stays, with and without an article around."""
    page = "<div><div><div><p>" + "long " * 80 + "</p></div></div></div><div><div><div><p>A short closing paragraph of the story, by the author.</p></div></div></div>"
    want = ("long " * 80).strip() + "\n\nA short closing paragraph of the story, by the author."
    assert extract(page) == extract(f"<article>{page}</article>") == want


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>Text <span class='ad'><span>Buy</span> now cheap</span> goes on</p>", "Text goes on"),
        ("<p>Text <span class=ad>a <b>b <span>c <span>d</span></span></b> e</span>goes on</p>", "Text goes on"),
        ("<p>Text <span class=ad>Buy</p><p>next</p><p><span>x</span></p>", "Text\n\nnext\n\nx"),
        ("<p>Text <span class=ad>stays without an end tag</p><p>next</p>", "Text stays without an end tag\n\nnext"),
        ("<div>Text <span class=ad><div>Buy</div> this</span> goes on</div>", "Text\n\ngoes on"),
        ("<p>Text <em class=ad>Buy</span> this</em> goes on</p>", "Text goes on"),
        ("<p>Text <SPAN class=ad>Buy</SPAN > goes <span class=ad></span>on</p>", "Text goes on"),
    ],
)
def test_inline_noise_ends_with_its_own_end_tag(html, want):
    assert extract(html) == want


@pytest.mark.parametrize("tail", ["", "</span>", "<b></b>"])
def test_a_page_of_open_inline_noise_takes_time_in_proportion(tail):
    page = "<p>" + "<span class=ad>" * 70_000 + "text" + tail  # 1 MB
    began = time.process_time()
    extract(page)
    assert time.process_time() - began < 2


def planted(rng):
    """A page without <article> or <main>, and its text: paragraphs of any length in boxes of any depth, with noise and inline noise anywhere."""
    noise = [
        "<nav><a href=/>Home</a> and more</nav>", "<aside>Related things</aside>", "<div class='cookie-notice'>We use cookies here</div>", "<form><p>Mail us</p></form>",
        "<div class=ad-box><div><p>Buy this now for little money</p></div></div>", "<div id=comments><p>I have read this too, and it is long enough</p></div>", "<script>var x='<p>';</script>",
    ]
    out, body = [], []
    for i in range(rng.randrange(1, 12)):
        words = [f"w{i}", *(rng.choice(["some", "words", "of", "text"]) for _ in range(rng.choice([3, 8, 60, 200])))]
        if rng.random() < 0.3:
            words.insert(1, "<span class=ad>Buy <span>now</span> <b>cheap</b></span>")
        block, depth = "<p>" + " ".join(words) + "</p>", rng.choice([0, 0, 1, 4, 9])
        out.append("<div>" * depth + block + "</div>" * depth)
        body.append(" ".join(w for w in words if "<" not in w))
        if rng.random() < 0.2:
            out.append(rng.choice(["<script>1</script>", "<!-- <p>no</p> -->", "<br>"]))
    long = f"<p>{'long ' * 400}</p>"
    at = rng.randrange(len(out) + 1)
    out.insert(at, long)
    body.insert(sum("<p>" in x and "no</p>" not in x for x in out[:at]), ("long " * 400).strip())
    return "".join(rng.sample(noise, 3)) + "<div>" + "".join(out) + "</div>" + "".join(rng.sample(noise, 3)), "\n\n".join(body)


def test_pages_without_article_keep_all_their_text():
    rng = random.Random(8)
    for _ in range(300):
        html, want = planted(rng)
        assert extract(html) == want, html
