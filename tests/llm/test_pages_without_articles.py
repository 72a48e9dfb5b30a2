"""Pages whose text isn't in an article element: every block of a run of text stays, whatever its length."""

import pytest

from warrantlake.llm import html_text

NAV = '<div class="top"><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/a">About us</a></li></ul></div>'
FOOT = '<div id="bottom"><ul><li><a href="/p">Privacy</a></li><li><a href="/t">Terms of use</a></li></ul></div>'


def paragraphs(number, words):
    return [" ".join(f"word{n}x{k}" for k in range(words)) + "." for n in range(number)]


def marked_up(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


@pytest.mark.parametrize("words", [1, 3, 5, 10, 15, 60])
@pytest.mark.parametrize("page", ['<body>{nav}<div class="post-body"><h1>A heading here</h1>{text}</div>{foot}</body>', '<body>{nav}<div id="content"><div><h2>A heading here</h2></div><div>{text}</div></div>{foot}</body>', "<body>{nav}<h1>A heading here</h1>{text}{foot}</body>"])
def test_paragraphs_of_any_length(words, page):
    texts = paragraphs(12, words)
    got = html_text.main_text(page.format(nav=NAV, foot=FOOT, text=marked_up(texts))).split("\n\n")
    assert [t for t in got if t != "A heading here"] == texts
    assert got[0] == "A heading here"


@pytest.mark.parametrize("outer", ["<body>%s</body>", '<body><div id="main-col">%s</div></body>', "<body>" + NAV + '<div class="recipe">%s</div>' + FOOT + "</body>"])
def test_a_list_between_paragraphs(outer):
    first, last = paragraphs(2, 30)
    items = ["flour", "two eggs", "a pinch of salt", "milk", "butter", "sugar", "one lemon", "water"]
    page = outer % f"<p>{first}</p><ul>{''.join(f'<li>{i}</li>' for i in items)}</ul><p>{last}</p>"
    assert html_text.main_text(page).split("\n\n") == [first, *items, last]


@pytest.mark.parametrize("page", ["<p>Hello world this is a short page.</p>", "<html><body><p>Hello world this is a short page.</p></body></html>", "<body><nav><a href=1>One</a></nav><div><p>Hello world this is a short page.</p></div><footer>(c) us</footer></body>"])
def test_a_page_of_one_short_paragraph(page):
    assert html_text.main_text(page) == "Hello world this is a short page."


@pytest.mark.parametrize("name", ["skip", "hidden-xs", "search", "register", "notice"])
def test_a_vague_name_around_all_the_text(name):
    texts = paragraphs(6, 50)
    assert html_text.main_text(f'<body>{NAV}<div id="{name}">{marked_up(texts)}</div>{FOOT}</body>').split("\n\n") == texts


@pytest.mark.parametrize("extra", ['<div class="user-feedback"><article>%s</article></div>', '<div class="legal">%s</div>', '<section class="comments"><article>%s</article></section>', '<div id="disclaimer">%s</div>'])
@pytest.mark.parametrize("body", ["<article>%s</article>", '<div class="post-body">%s</div>'])
def test_what_readers_and_lawyers_add_is_left_out(extra, body):
    texts, others = paragraphs(5, 40), ["some reader has said a thing or two"] * 3
    page = f"<body>{NAV}{body % marked_up(texts)}{extra % marked_up(others)}{FOOT}</body>"
    assert html_text.main_text(page).split("\n\n") == texts


@pytest.mark.parametrize("line", ["© 2024 Somebody and Sons", "Copyright 2019-2024 The Paper", "(c) the publisher of it all", "The Paper Ltd. All rights reserved."])
def test_a_copyright_line_in_an_unmarked_element(line):
    texts = paragraphs(6, 30)
    assert html_text.main_text(f'<body><div class="post">{marked_up(texts)}</div><div>{line}</div></body>').split("\n\n") == texts
    assert html_text.main_text(f"<body>{marked_up(texts)}<div>{line}</div></body>").split("\n\n") == texts
    inside = [*texts, "Copyright law has changed since the last century."]
    assert html_text.main_text(f"<body><article>{marked_up(inside)}</article></body>").split("\n\n") == inside


def test_menus_of_plain_words_and_lines_beside_the_text_are_left_out():
    texts = paragraphs(8, 20)
    page = f'<body><div><span>Menu</span></div>{NAV}<div class="post">{marked_up(texts)}</div><div>Printed in some town</div>{FOOT}</body>'
    assert html_text.main_text(page).split("\n\n") == texts


def test_sections_of_a_text_are_one_run():
    texts = paragraphs(9, 6)
    inner = "".join(f"<section><h3>Part {n}</h3>{marked_up(texts[3 * n : 3 * n + 3])}</section>" for n in range(3))
    got = html_text.main_text(f'<body>{NAV}<div class="text">{inner}</div>{FOOT}</body>').split("\n\n")
    assert [t for t in got if not t.startswith("Part")] == texts and len(got) == 12
