import html as entities
import random
import re
import time

import pytest

from flowloom.llm import html

WORDS = "river stone light under morning paper answer window garden quiet letter bridge ocean summer winter copper".split()


def say(chance, n=25):
    return " ".join(chance.choice(WORDS) for _ in range(n)).capitalize() + "."


def article(chance, k):
    """(page, main text) of a site with an article element, and everything around it."""
    title, paras = say(chance, 4), [say(chance) for _ in range(chance.randint(1, 5))]
    body = "".join(f"<p>{p}</p>\n" if chance.random() < 0.7 else f"<p class='lead{k}'>{p} <a href='/x'>more &amp; more</a>\n  text</p>" for p in paras)
    main = [title] + [re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.findall(r"<p.*?</p>", body, re.S)]
    return (
        f"<!doctype html><html><head><title>{title}</title><style>p{{}}</style></head><body><header><a href='/'>Site</a> slogan here</header>"
        f"<nav><ul>{''.join(f'<li><a href=/{w}>{w}</a>' for w in chance.sample(WORDS, 4))}</ul></nav>"
        + ("<div class='cookie-notice'>We use cookies <button>OK</button></div>" if k % 2 else "")
        + f"<main><article><header><h1>{title}</h1></header>{body}<script>if (a<b) document.write('</p>');</script></article>"
        f"<section id=comments><article class=comment><p>{say(chance)}</p></article></section></main>"
        f"<aside class=sidebar>{say(chance)}</aside><form><input name=q> Search</form><footer>&copy; {k}</footer></body></html>",
        "\n".join(main),
    )


def plain(chance, k):
    """A site without any telling element."""
    paras = [say(chance, 40) for _ in range(chance.randint(2, 6))]
    return (
        f"<html><body><div id=top><a href=/a>Home</a> <a href=/b>About</a></div><div id=c1><h2>{say(chance, 3)[:-1]} &lt;{k}&gt;</h2>" + "".join(f"<p>{p}<br>next line" for p in paras) + "</div>"
        f"<div id=r><a href=/{k}>{say(chance, 3)}</a> <a href=/z>{say(chance, 3)}</a></div><div id=bottom>All rights reserved by the site. Contact us at any time.</div></body></html>",
        None,
    )


@pytest.fixture(scope="module")
def answers(spark):
    chance, rows, want = random.Random(3), [], {}
    for k in range(40):
        page, main = article(chance, k)
        rows.append((k, f"http://a.example.com/{k}", page, "x"))
        want[k] = main
    for k in range(100, 120):
        page, _ = plain(chance, k)
        rows.append((k, f"https://B.example.org:80/{k}", page, "x"))
    rows += [(200, None, None, "x"), (201, "http://a.example.com/", "", "x"), (202, "no url", "<p>only &eacute; text", "x"), (None, "http://c.d", "<div>" * 300 + "deep" + "</div>" * 300, "x"), (203, "http://a.example.com/", "< broken <b <p>a</p", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string").repartition(5)
    return {r["page_id"]: r for r in html.extract_text(pages).collect()}, want, len(rows)


def test_articles_without_what_surrounds_them(answers):
    got, want, _ = answers
    assert {k: got[k]["text"] for k in want} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_sites_without_telling_elements(answers):
    got, _, _ = answers
    for k in range(100, 120):
        text = got[k]["text"]
        assert f"<{k}>" in text and "next line" in text and "Home" not in text and "reserved" not in text


def test_odd_rows(answers):
    got, _, n = answers
    assert len(got) == n
    assert got[200]["text"] == "" == got[201]["text"] and got[200]["n_chars"] == 0
    assert got[202]["text"] == "only é text" and got[None]["text"] == "deep"


def test_empty_table(spark):
    assert html.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_given_pages_match_their_article_element(spark):
    rows = html.extract_text(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    for r in rows:
        inside = pages[r["page_id"]].partition("<article>")[2].partition("</article>")[0]
        blocks = (re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:p|h1)>", inside))
        assert r["text"] == "\n".join(b for b in blocks if b)


def test_patterns_show_options_and_repeats(spark):
    rows = [(1, "http://h.x/1", "<body><h1>a</h1><p>b<p>c<ul><li>1<li>2</ul></body>"), (2, "http://h.x/2", "<body><h1>z</h1><div class=note>n</div><p>b</body>")]
    pattern = html.infer_wrappers(spark.createDataFrame(rows, "page_id long, url string, html string")).first()["pattern"]
    assert pattern in ("root(body(h1(#) div.note(#)? p(#)+ ul(li(#)+)?))",)


@pytest.mark.parametrize(
    "opening, closing",
    [
        ("<body class='page right-sidebar'><main>", "</main></body>"),
        ("<body><main class='has-sidebar'>", "</main></body>"),
        ("<body><article class='post tags-news'>", "</article></body>"),
        ("<body><div id=page class='site login'><div>", "</div></div></body>"),
        ("<body><form id=aspnet><div class=login><article>", "</article></div></form></body>"),
        ("<body><div class='has-sidebar'><div class=content>", "</div></div></body>"),
    ],
)
def test_names_and_forms_around_a_page_drop_nothing_of_it(spark, opening, closing):
    chance = random.Random(7)
    paras = [[say(chance) for _ in range(3)] for _ in range(5)]
    rows = [(k, f"http://w.example/{k}", f"<html>{opening}{''.join(f'<p>{p}</p>' for p in ps)}<div class=sidebar>{say(chance, 5)}</div><div class=site-footer>{say(chance, 5)}</div>{closing}</html>") for k, ps in enumerate(paras)]
    got = {r["page_id"]: r["text"] for r in html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: "\n".join(ps) for k, ps in enumerate(paras)}


def test_layouts_of_one_host_and_pages_without_a_host(spark):
    chance, rows, want = random.Random(11), [], {}
    layouts = ["<main><article>{}</article></main>", "<main><div>{}</div></main>", "<div class=post>{}</div>", "<div id=c1>{}</div>"]
    for k in range(40):
        paras = [say(chance, 40) for _ in range(3)]
        page = f"<html><body><nav><a href=/>Home</a></nav>{layouts[k % 4].format(''.join(f'<p>{p}</p>' for p in paras))}<footer>foot {k}</footer></body></html>"
        for at, url in ((k, f"http://mixed.example/{k}"), (100 + k, "no url")):
            rows.append((at, url, page))
            want[at] = "\n".join(paras)
    got = html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert {r["page_id"]: r["text"] for r in got} == want


def text_of(page):
    wrapper = html.wrapper_of(html.parse(page))
    html.choose(wrapper)
    return html.read(html.parse(page), wrapper)


def test_quotes_only_open_values():
    assert text_of("<p title=it's>x</p><p>don't</p>") == ["x", "don't"]
    assert text_of("<p title=\"a>b\" data-id='sidebar'>x</p><p a = 'c>d'>y</p>") == ["x", "y"]
    assert text_of("<p>one</p><a href='x>two</a><p>three</p>") == ["one", "two", "three"]
    assert text_of("a < b and <c") == ["a < b and <c"]


def test_deep_and_broken_pages_take_linear_time():
    began = time.time()
    for n in (1_000, 100_000):
        assert text_of("<div>" * n + "deep" + "</div>" * n + "<p>after</p>") == ["deep", "after"]
    assert text_of("<li><ul>" + "<div>" * 20_000 + "<li>x</li>" * 20_000)[0] == "x"
    for page in ("<a 'x " * 200_000, "<a x=\">\" " * 200_000, "<" * 1_000_000, "<!" * 500_000, "<select>" * 100_000, "<a x='" * 200_000, "<p " + "x" * 1_000_000 + ">y"):
        html.parse(page)
    assert time.time() - began < 60


def test_long_levels_are_generalised():
    pages = ["<body>" + "".join(f"<div class='k{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}x{s}'>text {k} {s}</div>" for k in range(3_000)) + "</body>" for s in "abc"]
    began = time.time()
    wrapper = html.wrapper_of(html.parse(pages[0]))
    for page in pages[1:]:
        wrapper = html.absorb(wrapper, html.wrapper_of(html.parse(page)))
    assert len(html._packed(wrapper)) < 5_000
    html.choose(wrapper)
    assert len(html.read(html.parse(pages[2]), wrapper)) == 3_000
    assert time.time() - began < 20


def test_matches_of_long_sequences():
    chance = random.Random(3)
    for size in (30, 900):
        a = [f"t{chance.randint(0, size)}" for _ in range(size)]
        b = [x for x in a if chance.random() > 0.2]
        found = html.matches(a, b)
        assert all(a[p] == b[q] for p, q in found) and all(p < r and q < s for (p, q), (r, s) in zip(found, found[1:]))
        assert len(found) > 0.8 * len(b)


def test_a_page_of_many_megabytes():
    page = "<main>" + "".join(f"<p class='a{k % 7}'>paragraph {k} of this long page</p>" for k in range(150_000)) + "</main><footer>end</footer>"
    got = text_of(page)
    assert len(got) == 150_000 and got[-1] == "paragraph 149999 of this long page"
