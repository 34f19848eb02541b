"""Pages without marks in other languages, and elements that are left open."""

import pytest

from narrata.llm import html_text

MENU = "<div><a href=x>Home page</a> <a href=y>About us</a></div>"
PROSE = {
    "it": "Il governo italiano presenta oggi alla stampa nuove misure economiche, mentre gli esperti discutono animatamente degli effetti sulla crescita. ",
    "pl": "Rada miasta przedstawiła dziś nowe rozwiązania dotyczące komunikacji, jednak mieszkańcy nadal czekają na szczegóły oraz terminy budowy. ",
    "ru": "Сегодня городской совет представил новые решения для транспорта, однако жители по-прежнему ждут подробностей и сроков строительства. ",
    "zh": "市议会今天公布了新的交通方案,居民们仍在等待有关建设时间和费用的详细说明,专家认为这一计划还需要更多讨论。",
    "dense": "Asynchronous replication protocols tolerate network partitions; consensus algorithms guarantee linearizable writes despite crashed replicas, clock skew, message reordering. ",
}


@pytest.mark.parametrize("name", PROSE)
def test_long_blocks_without_links_stay(name):
    body = " ".join((PROSE[name] * 3).split())
    notice = "We use the cookies of this site and you are to say that it is all right for us."
    assert html_text.main_text(f"{MENU}<p>{body}</p><p>{body}</p>{MENU}") == f"{body}\n{body}"
    assert body in html_text.main_text(f"{MENU}<p>{notice}</p><p>{body}</p><p>{body}</p>{MENU}")


def test_stop_words_still_tell_lists_from_prose():
    body = " ".join(("This is the long text of the page and it has many of the words that are in the list of stop words, so it is good. " * 3).split())
    tags = "red green blue yellow orange purple violet indigo black white silver golden bronze copper"
    assert html_text.main_text(f"<p>{body}</p><p>{body}</p><div>{tags}</div>{MENU}") == f"{body}\n{body}"


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>x</title><body><article><p>Main</p><p>Text</p></article></body></html>",
        "<html><head><meta charset=utf-8><title>x</title><link rel=a href=b><article><p>Main</p><p>Text</p></article>",
        "<html><head><title>x<body><article><p>Main</p><p>Text</p></article>",
        "<article><p><svg class=icon href='#a' />Main</p><p>Text</p></article>",
        "<article><p><svg viewBox='0 0 1 1'><g><path d=x /><text>no</text></g></svg>Main</p><p>Text <svg><g>no</p></article>",
        "<article><p><svg><foreignObject><div>no</div></foreignObject></svg>Main</p><p>Text</p></article>",
        "<article><p>Main<button>no</p><p>Text</p></article>",
        "<article><div><select><option>no<option>no</div><p>Main</p><p>Text</p></article>",
        "<article><p>Main</p><object data=x>no<p>Text</p></article>",
        "<article><p>Main</p><div><canvas><b>no</b></div><p>Text</p></article>",
        "<article><p>Main</p><iframe src=x><p>Text</p></article>",
        "<article><p>Main with a <a href=x>link</p><p>Text that goes on for a while</article>",
        "<article><div class='share-price-report'><p>Main</p></div><p>Text</p><div class='social-share-buttons'>no</div></article>",
        "<article><p title=5\" class='a'>Main</p><p>Text</p></article>",
        "<article><header class='article-header'><h1>Main</h1></header><p>Text</p><div class='commentList'>no</div></article>",
        "<article><p>Main</p><button><div>no</div></button><p>Text<noscript><p>no</p></noscript></p><script>no</p>",
    ],
)
def test_open_elements_end_with_their_parents(page):
    assert html_text.main_text(page).replace(" with a link", "").replace(" that goes on for a while", "") == "Main\nText"


PARAGRAPH = "This is the long text of the page and it has many of the words that are in the list of stop words, so it is good. " * 3
LINKS = "<p><a href=x>one link</a> <a href=y>other link</a> end</p>"


def _labels(page, passes):
    found = html_text.blocks(page)
    if passes == 2:
        html_text.classify(found)
        return [b.label for b in found]
    listed = html_text._listed(found)
    return [html_text._alone(b, listed) for b in found]


@pytest.mark.parametrize("start", ["<div>", "<article>"])
def test_second_pass_decides_what_the_first_leaves_open(start):
    """Short blocks follow their neighbours, in and out of articles; the marks of a page only shift what counts."""
    page = f"{start}<p>{PARAGRAPH}</p><p>Short.</p><p>{PARAGRAPH}</p>{LINKS}<p>Tail.</p>{LINKS}"
    assert _labels(page, 1) == ["good", "short", "good", "bad", "short", "bad"]
    assert _labels(page, 2) == ["good", "good", "good", "bad", "bad", "bad"]
    single = f"{start}<p>{PARAGRAPH}</p><p>Tail.</p>{LINKS}"  # one neighbour for it and one against it
    assert _labels(single, 2) == (["good", "good", "bad"] if start == "<article>" else ["good", "bad", "bad"])


def test_articles_that_hold_less_than_the_page_count_for_nothing():
    teaser = "<article><h3><a href=x>Other story</a></h3><p>Read it.</p></article>"
    body = " ".join(PARAGRAPH.split())
    assert html_text.main_text(f"<div><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></div>{LINKS}{teaser}{LINKS}{teaser}") == f"{body}\n{body}"


def test_blocks_beside_the_article_are_bad_though_they_are_dense():
    body = " ".join(PARAGRAPH.split())
    assert html_text.main_text(f"<article><p>{PARAGRAPH}</p><p>x</p></article><div>{PARAGRAPH}</div>") == f"{body}\nx"


def test_many_open_elements_take_linear_time():
    import time

    started = time.monotonic()
    assert html_text.main_text("<iframe><button><p>" * 20000 + "Text") == "Text"
    assert time.monotonic() - started < 20
