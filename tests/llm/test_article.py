"""What stands beside an article's main subtree, and parts whose names only sound like surroundings."""

import itertools

import pytest

from citelink.llm.html_text import main_text

LINES = [f"Paragraph {i} of the article goes on with several words until it is about one hundred and ten characters long ok." for i in range(5)]
BODY = "".join(f"<p>{x}</p>" for x in LINES)
INNER, WANT = f"<div>{BODY}</div>", "\n".join(LINES)
NAV, FOOT = '<nav><a href=x>Home</a> <a href=y>About us</a></nav>', "<footer>Copyright 2020 Example, all rights reserved</footer>"
PLACES = [a.format(b) for a, b in itertools.product(("{}", f"<html><body>{NAV}{{}}{FOOT}</body></html>"), ("{}", "<div id=content>{}</div>"))]
BARE = "Text of no element of its own, eighty characters long, stands beside all of that"


@pytest.mark.parametrize("place", PLACES)
@pytest.mark.parametrize("tag", ["h1", "h2"])
@pytest.mark.parametrize("title", ["Title", "A heading of sixty-four characters, as blogs and papers have them", "long " * 23 + "title"])
def test_heading_beside_the_main_subtree(place, tag, title):
    assert main_text(place.format(f"<{tag}>{title}</{tag}>{INNER}")) == f"{title}\n{WANT}"


@pytest.mark.parametrize("place", PLACES)
@pytest.mark.parametrize(
    ("beside", "text"),
    [
        ("<ul>" + "".join(f"<li>{x}</li>" for x in LINES[:4]) + "</ul>", "\n".join(LINES[:4])),
        ("<ul><li>one short</li><li>two short</li></ul>", "one short\ntwo short"),
        (f"<table><tr><td>{LINES[0]}</td></tr></table>", LINES[0]),
        (f"<blockquote>{LINES[1]}</blockquote>", LINES[1]),
        (BARE, BARE),
        (f"{BARE[:40]}<b>{BARE[40:]}</b>", BARE),
        (f"<div><p>{LINES[2]}</p></div>", LINES[2]),
        (f"<div><h2>Second</h2><p>{LINES[2]}</p></div>", f"Second\n{LINES[2]}"),
    ],
)
def test_text_beside_the_main_subtree(place, beside, text):
    assert main_text(place.format(INNER + beside)) == f"{WANT}\n{text}"
    assert main_text(place.format(beside + INNER)) == f"{text}\n{WANT}"


@pytest.mark.parametrize("within", ["article", "main"])
@pytest.mark.parametrize("part", ['div class="market-share"', 'div class="related-work"', 'div class="legal-notice"', "section id=ads", 'section id="related"'])
@pytest.mark.parametrize("heading", ["", "Heading"])
def test_parts_of_an_article_keep_their_names(within, part, heading):
    inner = (f"<h2>{heading}</h2>" if heading else "") + f"<p>{LINES[0]}</p>"
    page = f"<body>{NAV}<{within}>{BODY}<{part}>{inner}</{part.split()[0]}></{within}>{FOOT}"
    assert main_text(page) == "\n".join(x for x in (WANT, heading, LINES[0]) if x)


@pytest.mark.parametrize("within", ["article", "main"])
@pytest.mark.parametrize(
    "part",
    [
        '<div class="ad-box"><p>Buy now, a long advert text that goes on and on and on.</p></div>',
        '<div class="related-links"><ul><li><a href=x>One other article</a></li><li><a href=y>Two other articles</a></li></ul></div>',
        '<div class="share">Share on</div>',
        '<div class="cookie-notice"><p>We use cookies to make this site better for all of you and so on.</p></div>',
        '<div class="newsletter"><p>Subscribe now</p><form><input></form></div>',
        "<section id=comments><p>I don't agree with any of it, and say so at some length, as readers do.</p></section>",
    ],
)
def test_surroundings_inside_an_article_go(within, part):
    assert main_text(f"<body>{NAV}<{within}>{BODY}{part}</{within}>{FOOT}") == WANT
