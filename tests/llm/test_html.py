"""Articles that all pages of a host share, readers' threads, names within articles, and hostile markup."""

import random
import time

import pytest

from gristmill.llm import html_text


def host_region(pages):
    wrapper = None
    for page in pages:
        new = html_text.expression(html_text.parse(page))
        wrapper = html_text.align(wrapper, new) if wrapper else new
    return html_text.main_region(wrapper)


def prose(rng, n):
    return " ".join(rng.choice("abcdefghij") * rng.randrange(2, 9) for _ in range(n))


@pytest.mark.parametrize("tag", ["article", "div class='c'"])
def test_an_article_that_all_pages_share(tag):
    rng = random.Random(2)
    paragraphs = [prose(rng, 40) for _ in range(6)]
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    pages = [f"<body><nav>go</nav><{tag}>{body}</{tag.split()[0]}><div class='x{k}'>{prose(rng, 15)}</div></body>" for k in range(4)]
    region = host_region(pages)
    for page in pages:
        assert html_text.extract(page, region).split("\n") == html_text.extract(page, None).split("\n")[: len(paragraphs)] == paragraphs


def test_shared_paragraphs_beside_slots_in_one_element():
    rng = random.Random(3)
    paragraphs = [prose(rng, 40) for _ in range(6)]
    pages = [f"<body><div class='c'>{''.join(f'<p>{p}</p>' for p in paragraphs)}<p>{prose(rng, 6)}</p></div></body>" for _ in range(4)]
    assert html_text.extract(pages[0], host_region(pages)).split("\n")[:6] == paragraphs


def posts(rng, many, sign="{name}, {day} May 2020", body=30):
    return "".join(f"<div class='p{k}'><div>{sign.format(name=prose(rng, 1), day=k + 1)}</div><p>{prose(rng, body)}.</p></div>" for k in range(many))


@pytest.mark.parametrize("tag", ["article", "div class='c'"])
def test_a_long_thread_beside_a_short_article(tag):
    rng = random.Random(4)
    text = prose(rng, 60)
    page = f"<body><{tag}><p>{text}</p></{tag.split()[0]}><div class='thread'><h2>30 opinions</h2>{posts(rng, 30)}</div></body>"
    assert html_text.extract(page, None) == text
    pages = [f"<body><{tag}><p>{prose(rng, 60)}</p></{tag.split()[0]}><div class='thread'><h2>opinions</h2>{posts(rng, 9 + k)}</div></body>" for k in range(5)]
    region = host_region(pages)
    assert all(html_text.extract(p, region) == p.partition("<p>")[2].partition("</p>")[0] for p in pages)


@pytest.mark.parametrize("sign", ["{name} 2020-05-{day}", "{name}</div><div>Answer this"])
def test_a_thread_within_the_article(sign):
    rng = random.Random(5)
    text = prose(rng, 50)
    page = f"<body><article><h1>T</h1><p>{text}</p><div class='zz'><h3>What people say</h3>{posts(rng, 4, sign)}</div></article></body>"
    assert html_text.extract(page, None).split("\n") == ["T", text]


def test_sections_lists_and_questions_are_no_thread():
    rng = random.Random(6)
    section = "".join(f"<section><h2>Part {k}</h2><p>{prose(rng, 30)}.</p></section>" for k in range(4))
    faq = "".join(f"<div class='q'><div>{prose(rng, 5)}?</div><p>{prose(rng, 30)}.</p></div>" for _ in range(4))
    steps = "".join(f"<li><p>{prose(rng, 12)}.</p><p>{prose(rng, 12)}.</p></li>" for _ in range(5))
    page = f"<body><article>{section}{faq}<ol>{steps}</ol></article></body>"
    assert len(html_text.extract(page, None).split("\n")) == 8 + 8 + 10


@pytest.mark.parametrize("name", ["share", "skip", "search", "alert", "toc", "related"])
def test_weak_names_keep_paragraphs_within_an_article(name):
    rng = random.Random(7)
    text, more = prose(rng, 40), prose(rng, 30)
    links = "".join(f"<a href='/{k}'>{prose(rng, 6)}</a> " for k in range(9))
    page = f"<body><article><p>{text}</p><div class='{name}'><p>{more}</p></div><div class='{name}'><p>{links}</p></div><div class='{name}'>short</div></article><div class='{name}'><p>{more}</p></div></body>"
    assert html_text.extract(page, None).split("\n") == [text, more]
    assert html_text.extract(page.replace(f"'{name}'", "'comments'"), None).split("\n") == [text]


HOSTILE = {
    "open quotes": "<p class='",
    "open quotes, tags end": "<p class='>x",
    "two kinds": "<p a=\"'>'<b c='\">",
    "no end": "<p <b ",
    "declarations": "<!x <?y ",
    "nested": "<x-a>t ",
    "deep": "<div>t",
    "inline": "a <b>b</b> ",
    "stray ends": "x</zz> ",
    "raw": "<title>t ",
}


@pytest.mark.parametrize("name", HOSTILE)
def test_a_page_costs_its_length(name):
    page = "<body><p>first text</p>" + HOSTILE[name] * ((1 << 20) // len(HOSTILE[name]))
    began = time.process_time()
    html_text.parse(page)
    assert time.process_time() - began < 8  # 1 MB; the quadratic form took hours for the first
    small = "<body><article><p>one</p>" + HOSTILE[name] * 20
    assert html_text.extract(small, None).startswith("one")


def test_quotes_end_with_their_tag():
    page = "<body><article><p class='a>b' title=\"c>d\">one</p><p class='open>two</p><p>three</p></article></body>"
    assert html_text.extract(page, None).split("\n") == ["one", "two", "three"]
    assert html_text.extract("<body><article>1 < 2 <3 & <- x</article></body>", None) == "1 < 2 <3 & <- x"
