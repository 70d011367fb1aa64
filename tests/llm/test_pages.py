"""HTML extraction: what differencing decides, what markup may skip, and neighbours."""

import random

import pytest

from tessera.llm import pages


def test_differencing_decides_lines_outside_the_main_element(spark):
    page = "<p>Site name</p><article>teaser {0}</article><div>The story {0} itself.</div><p>All rights reserved</p>"
    df = spark.createDataFrame([(k, f"https://h.example/{k}", page.format(k)) for k in range(4)], "page_id bigint, url string, html string")
    assert {r.page_id: r.text for r in pages.extract(df).collect()} == {k: f"teaser {k} The story {k} itself." for k in range(4)}


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article class='post has-sidebar'>a</article>", "a"),
        ("<div class='page with-sidebar'><p>b</div>", "b"),
        ("<div id='search-results'>c</div><p class='side-by-side'>d</p><div class=no-nav>e</div>", "c d e"),
        ("<div class='entry-header'><h1>T</h1></div><div class='site-footer'>f</div><p class='ad-slot-3'>g</p>x", "T x"),
        ("<article class='sidebar'>a</article>", "a"),
        ("<div class='widget'>intro<article>a</article>rest</div>", "intro a rest"),
        ("<main>a<div id=comments>c<article class=comment-body>d</article></div>b</main>", "a b"),
        ("<body><div><nav><ul><li>menu</ul></div><p>text</p></body>", "text"),
        ("<body><div><div class=ad>buy<p>now</div></div><p>text</p></body>", "text"),
        ("<body><table><tr><td><div class=ad>buy<td>text</table>more</body>", "text more"),
        ("<body><nav><ul><li>menu</ul><p>text</p></body>", "menu text"),
        ("<body><div class=ad>buy<p>text</body>", "buy text"),
        ("<aside>s<article>a</article>t</aside>b", "a b"),
        ("<p data-role=banner title='class=ad'>a</p><p hidden>h</p><span class=ad>x<span>y</span>z</span>b", "a b"),
        ("<head><meta name=x><body><p>text<p class=ad>end", "text"),
    ],
)
def test_what_markup_skips(page, text):
    assert pages.main_text(pages.page_lines(page), None) == text


@pytest.fixture
def parts(spark):
    name = "spark.sql.shuffle.partitions"
    was = spark.conf.get(name)
    yield lambda n: spark.conf.set(name, n)
    spark.conf.set(name, was)


def test_copies_and_crawls_keep_their_text(spark, parts):
    page = "<p>Site name</p><p>{}</p><p>All rights reserved</p>"
    rows = [("a", "story"), ("a", "story"), ("b", "story"), ("c", "other"), ("c", "other, again"), ("d", "other"), ("e", "last")]
    df = spark.createDataFrame([(k, f"https://h.example/{u}", page.format(t)) for k, (u, t) in enumerate(rows)], "page_id bigint, url string, html string")
    for n in (1, 2, 7):
        parts(n)
        assert {r.page_id: r.text for r in pages.extract(df).collect()} == {k: t for k, (_, t) in enumerate(rows)}


def test_neighbours_equal_brute_force_for_any_parts(spark, parts):
    rng, rows = random.Random(5), []
    for k in range(240):
        host, path = rng.choice(["a", "b", "b", "b", "b", ""]), rng.choice("pqrstuvwxy") * rng.choice([1, 1, 2])
        html = "".join(f"<p>{x}" for x in rng.sample("uvwxyz", rng.choice([0, 1, 1, 2, 3])))
        rows.append((k, f"http://{host}/{path}" if host else None, html))
    rows += [(240 + k, f"http://c/{k:03d}", "<p>one<p>page") for k in range(40)] + [(280, "http://c/999", "<p>one<p>end")]
    rows += [(300 + k, "http://d/same", f"<p>t<p>{k}") for k in range(40)] + [(340, "http://d/z", "<p>t<p>3")]
    order = sorted((r for r in rows if r[1]), key=lambda r: (r[1][7:], r[0]))
    lines = {k: pages.page_lines(h) for k, _, h in rows}
    expected = {k: pages.main_text(lines[k], None) for k, _, _ in rows}
    for i, (k, url, _) in enumerate(order):
        for k2, url2, _ in [*order[:i][::-1], *order[i + 1 :]]:
            if url2[7] == url[7] and url2 != url and lines[k2][0] and lines[k2][0] != lines[k][0]:
                expected[k] = pages.main_text(lines[k], lines[k2])
                break
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for n in (1, 3, 16, 64):
        parts(n)
        assert {r.page_id: r.text for r in pages.extract(df).collect()} == expected


def test_differencing_comes_before_markup():
    """Shared menus and footers go by differencing, what differs per page by markup; without differencing unmarked template text stays."""
    page = "<nav><a>Home</a><p>Posts</nav><p>Site name<article><p>story {0}<p>A sentence both have.</article><p>Imprint<aside>advert {0}</aside><footer>since 2001</footer>"
    a, b = (pages.page_lines(page.format(k)) for k in (1, 2))
    assert dict(zip(a[0], pages.decisions(a, b))) == {
        "Home": "shared", "Posts": "shared", "Site name": "shared", "story 1": "main", "A sentence both have.": "main",
        "Imprint": "shared", "advert 1": "markup", "since 2001": "shared",
    }
    assert pages.main_text(a, b) == "story 1 A sentence both have."
    assert pages.main_text(a, None) == "Site name story 1 A sentence both have. Imprint"


@pytest.mark.parametrize("tag", ["section class='user-comments'", "ol class='commentlist'", "div class='js-ad'", "div class='adsbygoogle'", "div class='wp-block-social'", "div id='story-related'"])
def test_declared_names_with_any_word_before(tag):
    assert pages.main_text(pages.page_lines(f"<main>body<{tag}>gone</{tag.split()[0]}>more</main>"), None) == "body more"


@pytest.mark.parametrize("name", ["content-header", "card-form", "layout-no-sidebar", "with-nav", "two-col-sidebar-right", "map-side", "header-image", "download", "nomad", "shared-story"])
def test_other_names_stay(name):
    assert pages.main_text(pages.page_lines(f"<main>body<div class='{name}'>kept</div></main>"), None) == "body kept"


def test_both_steps_remove_lines_of_the_given_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("url", "page_id").collect()
    seen, before = {"shared": 0, "markup": 0}, None
    for r in rows:
        page = pages.page_lines(r.html or "")
        if before and before[0] == r.url.split("/")[2] and pages.digest(before[1]) != pages.digest(page):
            for why in pages.decisions(page, before[1]):
                seen[why] = seen.get(why, 0) + 1
        before = (r.url.split("/")[2], page)
    assert seen["shared"] > 0 and seen["markup"] > 0


def test_long_pages_ties_and_null_ids(spark, parts):
    """One very long page, rows that tie in everything, ids that are null: each gives its own row and the same text for any parts."""
    long = "<p>Site<article>" + "".join(f"<p>line {k} of it" for k in range(20_000)) + "</article><p>End"
    rows = [(1, "http://h/a", long), (2, "http://h/b", "<p>Site<p>two<p>End"), (2, "http://h/b", "<p>Site<p>two<p>End"), (None, "http://h/c", "<p>Site<p>none<p>End"), (None, "http://h/c", None), (None, None, None)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id bigint, url string, html string, text string, _host string")
    for n in (1, 5):
        parts(n)
        out = pages.extract(df).collect()
        assert sorted((str(r.page_id), str(r.url), r.text) for r in out) == sorted(
            [("1", "http://h/a", " ".join(f"line {k} of it" for k in range(20_000))), ("2", "http://h/b", "two"), ("2", "http://h/b", "two"), ("None", "http://h/c", "none"), ("None", "http://h/c", ""), ("None", "None", "")]
        )
