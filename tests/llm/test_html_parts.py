"""What is main text and what isn't, on hosts of a few pages."""

import random

import pytest

from flowloom.llm import html

WORDS = "river stone light under morning paper answer window garden quiet letter bridge ocean summer winter copper".split()


def say(chance, n=30):
    return " ".join(chance.choice(WORDS) for _ in range(n)).capitalize() + "."


def texts_of(pages):
    wrapper = None
    for page in pages:
        one = html.wrapper_of(html.parse(page))
        for slot in html._slots(one):
            slot.text = str(html.hash_of(slot.text)) if slot.text is not None else None
        wrapper = one if wrapper is None else html.absorb(wrapper, one)
    html.choose(wrapper)
    return ["\n".join(html.read(html.parse(p), wrapper)) for p in pages]


def checked(page, n=6, seed=1):
    """Pages from ``page(chance, k)``, which gives (html, main text)."""
    chance = random.Random(seed)
    made = [page(chance, k) for k in range(n)]
    assert texts_of([p for p, _ in made]) == [t for _, t in made]


def test_a_teaser_is_not_the_article():
    def page(chance, k):
        a, b = say(chance), say(chance)
        return f"<body><main><div><p>{a}</p><p>{b}</p></div><article class=teaser><p>Teaser {k}</p></article></main></body>", f"{a}\n{b}"

    checked(page)


@pytest.mark.parametrize("name", ["ad-slot", "user-comments-section", "cmt", "disqus_thread", "breadcrumb-trail", "page-content-footer-x", "site-newsletter-x"])
@pytest.mark.parametrize("main", ["<main>{}</main>", "<article>{}</article>", "<div class=content>{}</div>", "<div class=x>{}</div>"])
def test_parts_named_otherwise(name, main):
    def page(chance, k):
        a, b, c = say(chance), say(chance), say(chance, 8)
        part = f"<div class='{name}'><p>{c}</p></div>"
        return "<body>" + main.format(f"<p>{a}</p><p>{b}</p>{part}") + f"<div id='{name}'>{c}</div></body>", f"{a}\n{b}"

    checked(page)


def test_names_of_what_is_inside_and_of_headings():
    def page(chance, k):
        a, b, t = say(chance), say(chance, 60), say(chance, 5)
        return f"<body><div class='hero-content'><p>{say(chance, 6)}</p></div><h1 class=entry-title>{t}</h1><div class='entry-content has-comments no-sidebar'><p>{a}</p><p>{b}</p></div></body>", f"{t}\n{a}\n{b}"

    checked(page)


def test_lines_of_the_template():
    def page(chance, k):
        a, b = say(chance), say(chance)
        return f"<body><article><p>{a}</p><div>Call us any time, we never sleep!</div><p>{b}</p></article></body>", f"{a}\n{b}"

    checked(page)


def test_pages_that_are_the_same_keep_their_text():
    text = say(random.Random(1))
    assert texts_of([f"<body><article><p>{text}</p></article></body>"] * 5) == [text] * 5
    chance = random.Random(2)
    others = [say(chance) for _ in range(6)]  # three copies among others: what only they have is no template
    pages = [f"<body><article><p>{t}</p></article></body>" for t in others] + [f"<body><article><p>{others[0]}</p><p class=extra>Only here.</p></article></body>"] * 3
    assert texts_of(pages)[-3:] == [f"{others[0]}\nOnly here."] * 3


@pytest.mark.parametrize("how", ["hidden", "aria-hidden='true'", "style='color:red; display: none'", 'hidden=""'])
def test_hidden_text(how):
    def page(chance, k):
        a, b = say(chance), say(chance)
        return f"<body><article><p>{a} <span {how}>not <span>this</span> one </span><b>end</b></p><div {how}>{say(chance, 4)}</div><p>{b}</p></article></body>", f"{a} end\n{b}"

    checked(page)


def test_what_only_looks_hidden():
    def page(chance, k):
        a = say(chance)
        return f"<body><article><p class='a hidden b' title='is hidden' aria-hidden=false style='display:block'>{a}</p><p><span hidden>x<div>{a}</div></article></body>", f"{a}\n{a}"

    checked(page)
