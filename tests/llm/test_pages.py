"""Page forms for the main text: how pages wrap, cut up and surround an article."""

import time

import pytest

from docprep.llm.html_extract import main_text

TITLE = "A title of the page"
FIRST = "This is the first sentence, and it has commas, and it ends here."
SECOND = "Another paragraph, quite long, follows here; it goes on, and on, until it ends."
ARTICLE = f"<h1>{TITLE}</h1><p>{FIRST}</p><p>{SECOND}</p>"
WHOLE = f"{TITLE}\n{FIRST}\n{SECOND}"
MENU = "<ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/c>Contact</a></li></ul>"

FORMS = {
    "bare": ARTICLE,
    "body": f"<html><body>{ARTICLE}</body></html>",
    "article": f"<nav>{MENU}</nav><article>{ARTICLE}</article><footer><p>All rights, reserved.</p></footer>",
    "main": f"<header>{MENU}</header><main>{ARTICLE}</main>",
    "classes": f"<div class='page'><div class='nav'>{MENU}</div><div class='post'>{ARTICLE}</div></div>",
    "form around the page": f"<body><form id='aspnetForm' action='/x'><div>{ARTICLE}</div></form></body>",
    "form with a menu": f"<body><form><nav>{MENU}</nav><div id=main>{ARTICLE}</div><label>Name, please</label></form></body>",
    "field set around the page": f"<fieldset><div>{ARTICLE}</div></fieldset>",
    "header around the page": f"<header><div>{ARTICLE}</div></header>",
    "menu around the page": f"<menu><div>{ARTICLE}</div></menu>",
    "form beside": f"<div>{ARTICLE}</div><form><label>Your name, please.</label><p>Sign up, now.</p></form>",
    "form inside": f"<div>{ARTICLE}<form><label>Your name, please.</label><p>Sign up, now.</p></form></div>",
    "header inside": f"<article><header><p>Section, number, date</p></header>{ARTICLE}</article>",
    "aside inside": f"<article>{ARTICLE}<aside><p>See also this, and that.</p></aside></article>",
    "dialog": f"<dialog><p>We use cookies, as all do.</p></dialog><div>{ARTICLE}</div>",
    "table layout": f"<table><tr><td>{MENU}</td><td>{ARTICLE}</td></tr></table>",
    "nested tables": f"<table><tr><td><table><tr><td>{ARTICLE}</td></tr></table></td></tr></table>",
    "center": f"<center>{ARTICLE}</center>",
    "deep": "<div>" * 300 + ARTICLE + "</div>" * 300,
    "sections": f"<article><section><h1>{TITLE}</h1><p>{FIRST}</p></section><section><p>{SECOND}</p></section></article>",
    "name no-sidebar": f"<div class='layout no-sidebar'>{ARTICLE}</div>",
    "name has-header": f"<div class='page has-header' id='content'>{ARTICLE}</div>",
    "comments": f"<article>{ARTICLE}</article><div id='comments'><p>Nice, that one.</p><p>I do not think so, no.</p></div>",
    "comments of another name": f"<article>{ARTICLE}</article><div id='responses'><p>Nice, that one.</p><p>I do not think so, no.</p></div>",
    "advert": f"<article><h1>{TITLE}</h1><p>{FIRST}</p><div class='ad'><p>Buy this, now.</p></div><p>{SECOND}</p></article>",
    "share links": f"<article>{ARTICLE}<div class='share-links'><a>Mail</a><a>Print</a></div></article>",
    "scripts": f"<script>if (a<b) p('<p>x, y.</p>')</script><style>p{{x:y}}</style><div>{ARTICLE}</div><noscript>Turn it on, please.</noscript>",
    "comment markup": f"<!-- <p>old, text.</p> --><div>{ARTICLE}<!-- more, here. --></div>",
    "unclosed": f"<div><h1>{TITLE}<p>{FIRST}<p>{SECOND}".replace("<h1>" + TITLE, f"<h1>{TITLE}</h1>"),
    "upper case": f"<DIV><H1>{TITLE}</H1><P>{FIRST}</P><P>{SECOND}</P></DIV>",
    "inline": f"<div><h1>A <b>title</b> of <i>the</i> page</h1><p>{FIRST}</p><p>{SECOND}</p></div>",
    "references": f"<div><h1>A title of&#32;the&nbsp;page</h1><p>{FIRST.replace(',', '&#44;')}</p><p>{SECOND.replace(';', '&#x3b;')}</p></div>",
    "white space": f"<div><h1>\n A title\t of\n the page </h1>\r\n<p>{FIRST.replace(' ', '  ')}</p><p>{SECOND}</p></div>",
    "hidden": f"<div hidden><p>Not seen, at all.</p></div><div style='display : none'><p>Nor this, ever.</p></div><div>{ARTICLE}</div>",
    "stray ends": f"</div></span><div></b>{ARTICLE}</i></div></p></form>",
    "quoted marks": f"<div title='a > b' data-x=\"<p>no, text.</p>\">{ARTICLE}</div>",
    "image and drawing": f"<div><svg><path d='M0'/><text>x</text></svg><img alt='Seen, not read.'>{ARTICLE}</div>".replace("<text>x</text>", ""),
}


@pytest.mark.parametrize("form", FORMS)
def test_page_forms(form):
    assert main_text(FORMS[form]) == WHOLE


def test_several_articles_keep_their_page():
    page = "<main>" + "".join(f"<article><h2>Head {i}</h2><p>{FIRST} {i}</p></article>" for i in range(3)) + "</main>"
    text = main_text(page)
    assert all(f"Head {i}\n{FIRST} {i}" in text for i in range(3))


@pytest.mark.parametrize("page", [None, "", "  ", "<", "<div>", "<!--", "<script>x", "<nav><p>Only, a menu.</p></nav>", "\x00", "</p>" * 50])
def test_pages_without_text(page):
    assert main_text(page) in ("", "<", "\x00")


@pytest.mark.parametrize(
    "page",
    [
        lambda n: "<div>x, " * n,
        lambda n: "<article>" + "<span>x, " * n + "</b>" * n,
        lambda n: "<span><article>" + "<div>" * n + "y. " + "</span>" * n,
        lambda n: "<li>a, b" * n,
        lambda n: "<p>a, b<table><tr><td>" * n,
        lambda n: "<form><header class=nav>x, y. " * n,
        lambda n: "<svg>" + "<g/>" * n + "</svg>text, here.",
    ],
)
def test_time_grows_with_the_page(page):
    def seconds(n):
        best = 9.0
        for _ in range(3):
            start = time.process_time()
            main_text(page(n))
            best = min(best, time.process_time() - start)
        return best

    seconds(500)
    assert seconds(16_000) < 5 * 8 * seconds(2_000) + 0.2  # eight times the depth; a square would be sixty-four times
