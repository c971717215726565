"""Article text that stands beside, above or inside what used to be left out."""

import os
from html.parser import HTMLParser

import pytest

from quern.llm import queries
from quern.llm.html_text import main_text

SF = "/root/testdata/sf0.001"


def line(n, word="word"):
    return " ".join([word] * (n // (len(word) + 1) + 1))[:n].strip()


def test_text_above_the_densest_subtree():
    bare = "<br><br>".join(line(100, f"bare{k}") for k in range(40))
    quote = f"<blockquote><p>{line(150, 'q')}</p><p>{line(150, 'r')}</p></blockquote>"
    for tag in ("article", "main", "div"):
        text = main_text(f"<html><body><{tag}>{bare}{quote}</{tag}></body></html>")
        assert all(f"bare{k}" in text for k in range(40)) and line(150, "q") in text


def test_heading_above_the_densest_subtree():
    body = "".join(f"<p>{line(150, f'p{k}')}</p>" for k in range(20))
    text = main_text(f"<body><article><h2>Lead heading</h2><div>{body}</div><a href=x>more of it</a></article></body>")
    assert text.startswith("Lead heading\n\n") and "more of it" not in text


def test_short_sibling_that_reaches_the_threshold():
    body = "".join(f"<p>{line(150, f'p{k}')}</p>" for k in range(20))
    text = main_text(f"<body><p>{line(180, 'lead')}</p><div class=body>{body}</div></body>")
    assert text.startswith(line(180, "lead"))


PARA = "A paragraph of prose that speaks of something, and goes on for a while."
PAGE = "".join(f"<p>{PARA} {k}</p>" for k in range(8))
TEXT = "\n\n".join(f"{PARA} {k}" for k in range(8))


def test_left_out_elements_end_as_browsers_end_them():
    assert main_text(f'<body><div><p class="notice">Short notice{PAGE}</div></body>') == TEXT
    items = "".join(f"<li>{PARA} {k}" for k in range(8))
    assert main_text(f'<body><ul><li class="share">Share{items}</ul></body>') == TEXT
    assert main_text(f'<body><div><span class="ad">Advert</div><div>{PAGE}</div></body>') == TEXT
    assert main_text(f'<body><div><span class="ad"><span>x</span> y</span>{PAGE}</div></body>') == TEXT
    assert main_text(f"<html><head><title>t</title><body><div>{PAGE}</div></body>") == TEXT


def test_wrappers_named_as_noise_are_spared():
    for start, end in (('<form id="aspnetForm"><div>', "</div></form>"), ('<div class="content-sidebar-wrap"><article>', "</article></div>"), ('<article class="has-comments">', "</article>"), ('<main><div class="elementor-widget-text-editor">', "</div></main>"), ('<span class="widget">', "</span>"), ('<div class="has-comments"><div>', "</div></div>")):
        assert main_text(f"<body><nav><p>{PARA}</p></nav>{start}{PAGE}{end}<footer>us</footer></body>") == TEXT, start


def test_noise_beside_an_article_stays_out():
    for noise in ('<div class="ad">', '<section id="comments">', '<div class="cookie-notice">', '<form>'):
        close = "</" + noise[1:].split()[0].rstrip(">") + ">"
        assert main_text(f"<body>{noise}{PAGE}{close}<article><p>{PARA}</p></article></body>") == PARA
    assert main_text(f"<body><article>{PAGE}<div class=comments><article class=comment><p>{PARA}</p></article></div></article></body>") == TEXT
    assert main_text(f"<body><div hidden>{PAGE}</div><p>{PARA}</p></body>") == PARA


def test_comments_never_win():
    talk = "".join(f"<p>{PARA} reader {k}</p>" for k in range(12))
    items = "".join(f"<li class=comment><article><p>{PARA} reader {k}</p></article></li>" for k in range(30))
    for readers in (f'<div class="comments">{talk}</div>', f'<ul class="commentlist">{items}</ul>', f'<section id="post-comments">{talk}</section>', f'<div class="cookie-notice">{talk}</div>'):
        assert main_text(f"<body><div class=content><h1>T</h1><p>one sentence</p></div>{readers}</body>") == "T\n\none sentence"
        assert main_text(f"<body><div class=content><h1>T</h1>{PAGE}</div>{readers}</body>") == "T\n\n" + TEXT
        assert main_text(f"<body><article><h1>T</h1><p>one sentence</p>{readers}</article></body>") == "T\n\none sentence"
    assert main_text(f'<body><div class="comments">{talk}</div></body>') == ""
    assert main_text(f'<body><div class=content><h1>T</h1><p>one sentence</p></div><div class="sidebar">{talk}</div></body>') == "T\n\none sentence"


def test_short_lines_in_an_article():
    for tag in ("article", "main"):
        assert main_text(f"<body><nav>n</nav><{tag}><div>{PAGE}</div><p>The end of it.</p></{tag}><footer>f</footer></body>") == TEXT + "\n\nThe end of it."
        assert main_text(f"<body><{tag}><p>Short lead.</p><div>{PAGE}</div></{tag}></body>") == "Short lead.\n\n" + TEXT
        assert main_text(f"<body><{tag}>Bare lead.<div><div>{PAGE}</div></div><div>Written by A.</div></{tag}></body>") == f"Bare lead.\n\n{TEXT}\n\nWritten by A."
    assert main_text(f"<body><div><p>Short lead.</p><div>{PAGE}</div><p>The end.</p></div></body>") == f"Short lead.\n\n{TEXT}\n\nThe end."


def test_names_of_paragraphs():
    for name in "hidden-gem html-tags alert-story search-history widget-theory ad-hoc comment-on-law notice".split():
        for tag in ("p", "h2", "blockquote"):
            assert main_text(f'<body><article><h1>T</h1><{tag} class="{name}">Named line.</{tag}>{PAGE}</article></body>') == f"T\n\nNamed line.\n\n{TEXT}", (name, tag)
    assert main_text(f'<body><main><p class="ad-hoc-rule">Kept? By its first word it goes no more in main.</p><p class=ad>Buy.</p>{PAGE}</main></body>').endswith(TEXT)
    assert "Buy" not in main_text(f"<body><main><p class=ad>Buy.</p>{PAGE}</main></body>")
    for name in "ad ad-slot adSlot left-sidebar entry-related social_share".split():
        assert main_text(f'<body><article>{PAGE}<div class="{name}"><p>{PARA}</p></div></article></body>') == TEXT, name
    for name in "content-sidebar-wrap has-sidebar no-comments".split():
        assert main_text(f'<body><article><div class="{name}">{PAGE}</div></article></body>') == TEXT, name


def test_references_stay_and_menus_go():
    refs = "<ul><li><a href=a>Smith 2003</a></li><li><a href=b>Jones 2007</a></li></ul>"
    long = "<ol>" + "".join(f"<li><a href=a>{PARA} {k}</a></li>" for k in range(5)) + "</ol>"
    menu = "<ul>" + "".join(f"<li><a href=a>Topic {k}</a></li>" for k in range(8)) + "</ul>"
    assert main_text(f"<body><article>{PAGE}{refs}</article></body>") == TEXT + "\n\nSmith 2003\n\nJones 2007"
    assert main_text(f"<body><article>{PAGE}{long}</article></body>").count(PARA) == 13
    assert main_text(f"<body><article>{PAGE}{menu}</article></body>") == TEXT


def test_one_article_bounds_the_text():
    assert main_text("<body><div>Weather today is fine and dry.</div><article><h1>T</h1><p>One.</p></article><div>Try our shop today.</div></body>") == "T\n\nOne."


class Plain(HTMLParser):
    """The text of the page's only article by the standard library's parser, a block for each run between block-level tags."""

    BLOCKS = frozenset("p div h1 h2 h3 ul ol li article section blockquote".split())
    OUT = frozenset("script style nav footer aside form button".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.article, self.out, self.blocks = 0, 0, [""]

    def handle_starttag(self, tag, attrs):
        self.article += tag == "article"
        self.out += tag in self.OUT
        if tag in self.BLOCKS:
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.article -= tag == "article"
        self.out -= tag in self.OUT
        if tag in self.BLOCKS:
            self.blocks.append("")

    def handle_data(self, data):
        if self.article and not self.out:
            self.blocks[-1] += data

    @classmethod
    def of(cls, page):
        found = cls()
        found.feed(page or "")
        found.close()
        return "\n\n".join(x for x in (" ".join(b.split()) for b in found.blocks) if x)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_query_against_the_standard_parser(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    found = queries.QUERIES["op9_html_extraction"](spark, SF).collect()
    assert len(found) == len(pages) and found[0].__fields__ == ["page_id", "url", "text", "n_chars"]
    for r in found:
        assert r["text"] == Plain.of(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]
