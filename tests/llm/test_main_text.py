"""Main text: embedded elements, and what the repeats of a host take and leave."""

import pytest

from contractlens.llm import extraction
from contractlens.llm.markup import BESIDE, blocks

PAGE = "page_id long, url string, html string"


@pytest.mark.parametrize(
    "piece",
    ['<svg width="5"/>', "<math/>", "<canvas/>", "<iframe src='x'/>", "<svg><path d='M0'/></svg>", "<div><button>Buy</div>", "<div><select><option>a</div>", "<section><video><source src=a></section>", "<div><object>old</div>"],
)
def test_embedded_elements_do_not_cut_the_page(piece):
    got = [text for place, text in blocks(f"<article><p>One</p>{piece}<p>Two</p><p>Three</p></article>") if place != BESIDE]
    assert got == ["One", "Two", "Three"]


def story(i, n=30):
    return " ".join(f"word{i}x{k}" for k in range(n))


def texts(spark, rows):
    return {r.page_id: r.text for r in extraction.extract_main_text(spark.createDataFrame(rows, PAGE)).collect()}


def test_a_repeated_line_in_articles_goes(spark):
    line = "Sign up today and never miss one of our stories"
    rows = [(i, f"http://h/{i}", f"<article><p>{story(i)}</p><p>{line}</p><p>{story(i + 100)}</p></article>") for i in range(4)]
    # an article and its edited copy keep their text
    rows += [(10 + i, f"http://h/e{i}", f"<article><p>{story(50, 40)}</p><p>{story(51, 40)} edit{i}</p></article>") for i in range(2)]
    got = texts(spark, rows)
    assert got[2] == f"{story(2)} {story(102)}"
    assert got[10] == f"{story(50, 40)} {story(51, 40)} edit0" and got[11].endswith("edit1")


def test_copies_of_a_page_do_not_empty_each_other(spark):
    html = f"<body><div>{story(1)}</div><p>{story(2)}</p></body>"
    phrase = "as our readers already know"
    rows = [(1, "http://h/a", html), (2, "http://h/b", html), (3, None, html), (4, "::bad", html)]
    rows += [(5 + i, "http://h/c", f"<body><p>{phrase} {story(70 + i, 5)}</p><p>{story(80 + i)}</p></body>") for i in range(2)]
    got = texts(spark, rows)
    assert got[1] == got[2] == got[3] == got[4] == f"{story(1)} {story(2)}"
    assert got[5].startswith(phrase) and got[6].startswith(phrase)


def test_short_unique_blocks_beside_an_article_stay(spark):
    menu = "Home News Sport Culture Opinion Archive"
    page = lambda i: f"<body><div>{menu}</div><h1>Headline {story(i, 4)}</h1><article><p>{story(i + 10)}</p></article><p>The end {story(i + 20, 3)}</p></body>"
    got = texts(spark, [(i, f"http://h/{i}", page(i)) for i in range(3)])
    assert got[1] == f"Headline {story(1, 4)} {story(11)} The end {story(21, 3)}"


def test_other_date_lines_do_not_empty_copies(spark):
    """Near copies count as one page, however many there are."""
    page = lambda i: f"<body><p>{story(1, 80)}</p><p>{story(2, 60)}</p><div>Served 10:0{i}:{i * 7}</div></body>"
    got = texts(spark, [(i, "http://h/x", page(i)) for i in range(5)])
    assert got[3] == f"{story(1, 80)} {story(2, 60)} Served 10:03:21"


def test_quotes_and_short_sentences_of_two_pages_stay(spark):
    quote, line = story(5, 25), "The council met again on Monday"
    rows = [(i, f"http://h/{i}", f"<article><p>{story(10 + i)}</p><p>{quote} {story(20 + i, 20)}</p><p>{line}</p></article>") for i in range(2)]
    rows += [(i, f"http://h/{i}", f"<article><p>{story(10 + i)}</p></article>") for i in range(2, 5)]
    got = texts(spark, rows)
    assert got[1] == f"{story(11)} {quote} {story(21, 20)} {line}"


@pytest.mark.parametrize("name, kept", [("social-policy", True), ("share-price", True), ("notice-of-motion", True), ("ad-hoc", True), ("ad", False), ("ad-slot-2", False), ("social-share", False), ("newsletter signup-form", False), ("comment-list", False)])
def test_names_count_as_a_whole(name, kept):
    got = [t for p, t in blocks(f"<article><p>One</p><div class='{name}'>Two</div></article>") if p != BESIDE]
    assert got == (["One", "Two"] if kept else ["One"])


def test_only_the_repeated_tail_of_a_paragraph_goes(spark):
    tail = "Sign up today and never miss another one of our daily stories from the region by the people who write them here"
    rows = [(i, f"http://h/{i}", f"<article><p>{story(i, 40)} {tail}</p><p>{story(50 + i)}</p></article>") for i in range(5)]
    assert texts(spark, rows)[2] == f"{story(2, 40)} {story(52)}"


def brute(rows):
    """Every run of a host against every distinct page."""
    hosts = {}
    for i, url, html in rows:
        kept = [t for p, t in blocks(html or "") if p != BESIDE]
        hosts.setdefault(extraction.host(url), {})[i] = kept
    out = {}
    for pages in hosts.values():
        runs_of = lambda t: [tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))]
        contents = {tuple(sorted({r for t in kept for r in runs_of(t)})) for kept in pages.values() if kept}
        count = {}
        for c in contents:
            for r in set(c):
                count[r] = count.get(r, 0) + 1
        gone = {r for r, n in count.items() if n >= 3 and n >= len(contents) / 2}
        for i, kept in pages.items():
            left, lost, total = [], 0, 0
            for t in kept:
                words = t.split()
                cut = [False] * len(words)
                for k, r in enumerate(runs_of(t)):
                    if r in gone:
                        cut[k : k + len(r)] = [True] * len(r)
                lost, total = lost + sum(cut), total + len(cut)
                if not all(cut):
                    left.append(" ".join(w for w, c in zip(words, cut, strict=True) if not c))
            out[i] = " ".join(left if lost <= 0.9 * total else kept)
    return out


def test_equals_brute_force(spark):
    """Unmarked menus, notices inside paragraphs and notes of all sizes, on hosts of 1 to 30 pages."""
    import numpy as np

    rng = np.random.default_rng(9)
    rows, i = [], 0
    for h, n in enumerate([1, 2, 3, 4, 9, 30]):
        menu, notice = f"Home {h} News", " ".join(f"notice{h}w{k}" for k in range(22))
        for _ in range(n):
            paragraphs = [f"<p>{story(1000 + i * 10 + k, int(rng.integers(20, 50)))}</p>" for k in range(4)]
            if rng.random() < 0.9:
                paragraphs[1] = f"<p>{story(5000 + i, 12)} {notice} {story(7000 + i, 9)}</p>"
            rows.append((i, f"http://host{h}/{i}", f"<body><div>{menu}</div>{''.join(paragraphs)}<p>Related</p></body>"))
            i += 1
    got = texts(spark, rows)
    assert got == brute(rows)
    assert "notice5w3" not in got[i - 1] and "Home" not in got[i - 1] and "notice1w3" in got[1] + got[2]
