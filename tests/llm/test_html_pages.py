"""Main text of generated pages whose article is known, and of single points of markup."""

import html
import random
import time

import pytest

from tequant.llm.html_text import main_text

LONG = "One sentence, with commas, that goes on for long enough, to be the text of an article, and then some more of it. "
CHROME = (
    '<nav><ul><li><a href=/>Home</a></li><li><a href=/a>All</a></li></ul></nav>', '<div class="cookie-banner"><p>We use cookies, of course, on this page.</p></div>', "<footer><p>About, terms, and privacy</p></footer>",
    "<aside><h3>Most read</h3><ul><li><a href=/x>One</a></li></ul></aside>", '<section id="comments"><h2>Comments</h2><p>I disagree, wholly, with all of it, and so do many others.</p></section>',
    "<script>var x = '<p>not, text</p>';</script>", "<style>p { color: red }</style>", '<div class="ad"><p>Buy this, now, at once.</p></div>', "<form><label>Mail</label><input name=m></form>", "<!-- <p>old, text</p> -->",
)


def some_words(rng):
    return " ".join(rng.choice(("stone", "river", "AT&T", "a<b", "naïve", "“so”", "x > y", "tree", "né")) for _ in range(rng.randint(3, 30)))


def inline(rng, text):
    """The text as markup that shows the same: tags around words, references, white space."""
    out = []
    for w in text.split():
        w = html.escape(w) if rng.random() < 0.7 else "".join(f"&#{ord(c)};" for c in w)
        out.append(rng.choice((w, f"<b>{w}</b>", f"<a href='/w'>{w}</a>" if rng.random() < 0.2 else w, f"<span class=comment-like>{w}<wbr></span>", w)))
    return rng.choice((" ", "\n  ", "\t")).join(out)


def test_generated_articles():
    rng = random.Random(12)
    for _ in range(300):
        want, body = ["Title of " + some_words(rng)], []
        body.append(f"<h1>{inline(rng, want[0])}</h1>")
        for _ in range(rng.randint(1, 12)):
            kind = rng.choice(("p", "p", "p", "h2", "blockquote", "ul", "table", "div"))
            if kind == "ul":
                items = [some_words(rng) for _ in range(rng.randint(1, 4))]
                body.append("<ul>" + "".join(f"<li>{inline(rng, x)}" + rng.choice(("", "</li>")) for x in items) + "</ul>")
                want += items
            elif kind == "table":
                cells = [some_words(rng) for _ in range(4)]
                body.append("<table>" + "".join(f"<tr><td>{inline(rng, a)}<td>{inline(rng, b)}" for a, b in (cells[:2], cells[2:])) + "</table>")
                want += cells
            else:
                text = (LONG if kind == "p" and rng.random() < 0.5 else "") + some_words(rng)
                body.append(f"<{kind}{rng.choice(('', ' class=legal', ' id=search-results'))}>{inline(rng, text)}" + ("" if kind == "p" and rng.random() < 0.3 else f"</{kind}>"))
                want.append(" ".join(text.split()))
        around = rng.sample(CHROME, rng.randint(0, 6))
        cut = rng.randint(0, len(around))
        inner = rng.choice(("", '<div class="share"><a href=/t>Tell, others</a></div>', "<aside>See also, this</aside>"))
        page = f"<html><head><title>t</title></head><body>{''.join(around[:cut])}<article>{''.join(body)}{inner}</article>{''.join(around[cut:])}</body></html>"
        assert main_text(page) == "\n\n".join(" ".join(w.split()) for w in want)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p>super<wbr>cali<img src=x>fragi<br>listic</p></article>", "supercalifragi listic"),
        ("<article><p>&am<b>p;</b>lt; &amp;lt;</p></article>", "&amp;lt; &lt;"),
        (f"<body><!--><p>{LONG}</p><!---><p>{LONG}</p><!-- x --!><p>{LONG}</p>", "\n\n".join([LONG.strip()] * 3)),
        (f"<body><h1>T</h1><p class=by>By X</p><div><p>{LONG}</p></div><p>short tail</p>", f"T\n\nBy X\n\n{LONG.strip()}\n\nshort tail"),
        ("<article><h2 id=comments-on-law>Law</h2><section class=related-work><p>r, w</p></section><div class='ad'>A</div><p class=sponsored>B</p><div class=comments>C</div><p>end</p></article>", "Law\n\nr, w\n\nend"),
        ("<article><div>a<table><tr><td><b>x</div>y<td>z</b></table>q</div></article>", "a\n\nxy\n\nz\n\nq"),
        ("<article><ul><li>a<ul><li>b<li>c</ul>d<li>e</ul></article>", "a\n\nb\n\nc\n\nd\n\ne"),
        ("<article><p>a<p>b</b></i>c<dl><dt>d<dd>e<dt>f</dl></article>", "a\n\nbc\n\nd\n\ne\n\nf"),
        ("<main><header><h1>H</h1></header><p>x</p></main>", "H\n\nx"),
        ("", ""), (None, ""), (" \n", ""), ("<p>", ""),
    ],
)
def test_points_of_markup(page, text):
    assert main_text(page) == text


def test_depth_does_not_lessen_what_wins():
    deep = "<div>" * 40 + f"<p>{LONG}</p><p>{LONG}</p>" + "</div>" * 40
    assert main_text(f"<body><div><p>Short, one.</p></div>{deep}</body>").count(LONG.strip()) == 2


@pytest.mark.parametrize("page", ["<span>" * 8000 + "<li>" * 8000, "<div>" * 8000 + "</b>" * 8000, "<header>" * 8000, "<p>x" * 8000, "<ul><li>" * 8000, "<table><tr><td>" * 5000, "<div>t" * 8000, "<a href='" * 8000])
def test_no_nesting_takes_square_time(page):
    begun = time.process_time()
    main_text("<body>" + page)
    assert time.process_time() - begun < 3  # some 0.2 s; square time takes 4 to 18
