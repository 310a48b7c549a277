"""Main text: pages whose article is known because they are put together from its blocks and other things."""

import random

import pytest

from shopmetrics.llm.html_text import main_text

LONG = "This is a long paragraph, with some commas, and it goes on, so that it certainly counts as the text of an article and not as a label."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (
            f"<body><h1>Head</h1><div><p>{LONG}</p><p>{LONG}</p></div><h2>Second</h2><ul><li>one</li><li>two</li></ul><div><p>{LONG}</p></div></body>",
            ["Head", LONG, LONG, "Second", "one", "two", LONG],
        ),
        (
            f"<div class=story><h1>Head</h1><div class=wrap><p>{LONG}</p></div><p>short closing line.</p><pre>code</pre></div>",
            ["Head", LONG, "short closing line.", "code"],
        ),
        (
            f"<main><h1>T</h1><p>{LONG}</p><ul><li><a href=/1>First source</a></li><li><a href=/2>Second source</a></li></ul></main>",
            ["T", LONG, "First source", "Second source"],
        ),
        (f'<article><p class="promotion-terms">{LONG}</p><p class="lead nav-header-x">Lead.</p><p class="cookie-notice">We use cookies.</p></article>', [LONG, "Lead."]),
        (f"<body>Bare text before. <b>bold</b><div><p>{LONG}</p></div>Bare text after.</body>", ["Bare text before. bold", LONG, "Bare text after."]),
        (f"<body><ul><li><a href=/1>Home</a></li><li><a href=/2>News</a></li></ul><div><p>{LONG}</p></div><div>Other box</div></body>", [LONG]),
        (f"<body><div id=page><div><p>{LONG}</p><blockquote>Quoted.</blockquote></div><div><a href=/x>Some other story</a></div></div></body>", [LONG, "Quoted."]),
        ("<body><p>Only this.</p></body>", ["Only this."]),
        ("<html><head><title>x</title></head><body></body></html>", []),
        (f"<article><table><tr><th>Name</th><td>Value</td></tr></table><p>{LONG}</p></article>", ["Name", "Value", LONG]),
    ],
)
def test_article_is_whole(page, want):
    assert main_text(page) == "\n\n".join(want)


def block(rng):
    words = " ".join(rng.choice(["alpha", "beta,", "gamma", "d&eacute;lta", "x &lt; y", "<b>bold</b>", "<a href=/l>link</a>", "plain"]) for _ in range(rng.randint(12, 60)))
    text = words.replace("&eacute;", "é").replace("&lt;", "<")
    for tag in ("<b>", "</b>", "<a href=/l>", "</a>"):
        text = text.replace(tag, "")
    return rng.choice(["p", "p", "p", "blockquote", "pre"]), words, text


def other(rng):
    return rng.choice([
        "<nav><a href=/>Home</a> <a href=/n>News</a></nav>", "<aside><p>" + LONG + "</p></aside>", "<script>var x = '<p>no</p>';</script>",
        '<div class="cookie-banner">We use cookies, and more, and more.</div>', '<div id="comments"><p>' + LONG + "</p></div>", "<style>p{}</style>",
        '<form><p>Your name</p><input></form>', '<ul class="related-posts"><li>Other</li></ul>', "<!-- <p>hidden</p> -->", '<div class="advert"><p>Buy, buy.</p></div>',
    ])


@pytest.mark.parametrize("seed", range(60))
def test_generated_pages(seed):
    rng = random.Random(seed)
    parts, want = ["<h1>Title</h1>"], ["Title"]
    for _ in range(rng.randint(2, 9)):
        kind = rng.randrange(4)
        if kind == 0:
            parts.append("<h2>Heading</h2>")
            want.append("Heading")
        elif kind == 1:
            parts.append("<ul><li>item one</li><li>item two</li></ul>")
            want += ["item one", "item two"]
        tag, html, text = block(rng)
        parts.append(f"<{tag}>{html}</{tag}>")
        want.append(text)
        if rng.random() < 0.3:
            parts.append(other(rng))
    opened, closed = rng.choice([("<article>", "</article>"), ("<main>", "</main>"), ('<div class="story">', "</div>"), ("<div><div>", "</div></div>")])
    page = "<html><body>" + other(rng) + opened + "".join(parts) + closed + other(rng) + "<footer>&copy; us</footer></body></html>"
    assert main_text(page) == "\n\n".join(want)


def test_long_and_odd_pages():
    assert main_text("<article>" + f"<p>{LONG}</p>" * 3000 + "</article>").count(LONG) == 3000
    assert main_text("<div>" * 4000 + f"<p>{LONG}</p>") == LONG
    assert main_text(None) == main_text("") == main_text("<p></p>") == ""
