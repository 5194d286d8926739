"""Main texts of hand-made pages, and of generated pages whose text is known."""

from __future__ import annotations

import html
import random

import pytest

from quarryline.llm.main_text import main_text

P = [f"Paragraph number {i} tells a long story about many things, with enough words to be read as text and not as a label." for i in range(9)]
TEXT = "\n\n".join(P[:4])
BODY = "".join(f"<p>{p}</p>" for p in P[:4])
NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>'
COMMENTS = '<div id="comments">' + "".join(f'<article class="comment-body"><p>Reader {i} says that this is a fine and long comment on the matter at hand.</p></article>' for i in range(9)) + "</div>"


@pytest.mark.parametrize(
    "page",
    [
        f'<body>{NAV}<div class="layout has-sidebar">{BODY}</div></body>',
        f'<body>{NAV}<div class="post with-comments">{BODY}</div></body>',
        f'<body>{NAV}<div id="social-science">{BODY}</div></body>',
        f'<body><form action="/x">{NAV}<article>{BODY}</article></form></body>',
        f'<body><form id="aspnetForm">{NAV}<div id="content">{BODY}</div></form></body>',
        f'<body>{NAV}<div class="widget">{BODY}</div></body>',
        f'<body>{NAV}<article>{BODY}</article>{COMMENTS}</body>',
        f'<body>{NAV}<div id="content">{BODY}</div>{COMMENTS}</body>',
        f'<body><div class="site-header">Name of the site</div>{NAV}<main>{BODY}</main><div class="cookie-banner"><p>We use cookies on this page for many reasons.</p></div></body>',
        f'<body>{NAV}<article>{"".join(f"<p>{p}</p>" for p in P[:2])}</article><article>{"".join(f"<p>{p}</p>" for p in P[2:4])}</article></body>',
        f'<body>{NAV}<main><article>{"".join(f"<p>{p}</p>" for p in P[:2])}</article><article>{"".join(f"<p>{p}</p>" for p in P[2:4])}</article></main></body>',
        f'<body>{NAV}<div class="a">{"".join(f"<p>{p}</p>" for p in P[:2])}</div><div class="b">{"".join(f"<p>{p}</p>" for p in P[2:4])}</div><footer>Imprint</footer></body>',
        f'<body>{NAV}<section>{"".join(f"<p>{p}</p>" for p in P[:3])}</section><section><p>{P[3]}</p></section></body>',
    ],
)
def test_whole_text_and_nothing_else(page):
    assert main_text(page) == TEXT


def test_parts_of_an_article_stay():
    links = "<ul>" + "".join(f'<li><a href="/{i}">Source number {i}</a></li>' for i in range(5)) + "</ul>"
    page = f'<body>{NAV}<article><h1>Head</h1>{BODY}{links}<p class="share-price">It rose to 12.</p><p class="notice-of-death">He died at 90.</p></article></body>'
    assert main_text(page) == "\n\n".join(["Head", *P[:4], *(f"Source number {i}" for i in range(5)), "It rose to 12.", "He died at 90."])
    assert main_text("<body><ul><li><a href='/'>One link</a></li><li><a href='/2'>And another</a></li></ul></body>") == "One link\n\nAnd another"


def _generated(r):
    """A page and its text."""
    words = lambda n: " ".join("".join(r.choice("abcdefghij éß&<") for _ in range(r.randint(2, 9))).strip() or "x" for _ in range(n))
    blocks, parts = [], []
    for _ in range(r.randint(3, 12)):
        text = " ".join(words(r.randint(15, 60)).split())
        shown = html.escape(text)
        kind = r.choice(["p", "p", "p", "h2", "ul", "quote", "inline", "table"])
        if kind == "ul":
            items = [" ".join(words(r.randint(6, 20)).split()) for _ in range(r.randint(1, 4))]
            parts.append("<ul>" + "".join(f"<li>{html.escape(i)}</li>" for i in items) + "</ul>")
            blocks += items
            continue
        if kind == "table":
            cells = [" ".join(words(5).split()) for _ in range(3)]
            parts.append("<table><tr>" + "".join(f"<td>{html.escape(c)}</td>" for c in cells) + "</tr></table>")
            blocks += cells
            continue
        blocks.append(text)
        parts.append({"p": f"<p>{shown}</p>", "h2": f"<h2>{shown}", "quote": f"<blockquote><p>{shown}</p></blockquote>", "inline": f"<p>\n <b>{shown[:0]}</b>{shown}\t</p>"}[kind] + ("</h2>" if kind == "h2" else ""))
    wrap = r.choice(["article", "main", "div", "section", "form"])
    attributes = r.choice(["", ' class="content"', ' class="post has-sidebar"', ' id="story"', ' class="page with-footer wide"'])
    before = r.choice(["", NAV, f"<header><h2>Site</h2></header>{NAV}", '<div class="ad">Buy this now and here.</div>', "<script>var a='<p>no</p>';</script>"])
    after = r.choice(["", "<footer><p>Imprint and so on.</p></footer>", COMMENTS, '<aside><p>Also read this.</p></aside><div class="related-links"><a href="/">x</a></div>'])
    return f"<!DOCTYPE html><html><head><title>T</title></head><body>{before}<{wrap}{attributes}>{''.join(parts)}</{wrap}>{after}</body></html>", "\n\n".join(b for b in blocks if b)


def test_generated_pages_give_their_whole_text():
    r = random.Random(11)
    for _ in range(300):
        page, text = _generated(r)
        assert main_text(page) == text, page
