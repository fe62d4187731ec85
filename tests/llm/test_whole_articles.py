"""Blocks of an article that are mostly links."""

from treeloom.llm import html_text

TEXT = "<p>A paragraph, long enough, with commas, to count, as the text of an article.</p>" * 3
SAID = " ".join(["A paragraph, long enough, with commas, to count, as the text of an article."] * 3)


def test_linked_blocks_of_an_article_stay():
    page = f"<body><article><h2><a href=a>Linked heading</a></h2>{TEXT}<table><tr><td><a href=b>linked cell</a><td>7</table><p><a href=c>mostly a link</a> end</p><ul><li><a href=d>one</a><li>plain item of some length</ul></article></body>"
    assert html_text.main_text(page) == f"Linked heading {SAID} linked cell 7 mostly a link end one plain item of some length"


def test_article_of_links_is_not_empty():
    links = "".join(f"<p><a href=x>Linked paragraph, number {i}, that is long enough</a>, and so on, x.</p>" for i in range(3))
    assert "number 2" in html_text.main_text(f"<body><article>{links}</article></body>")


def test_menus_in_an_article_go():
    assert html_text.main_text(f"<body><article><ul><li><a href=a>Home</a><li><a href=b>Contact</a></ul>{TEXT}</article></body>") == SAID
