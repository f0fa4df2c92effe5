"""Main text of pages: markup, references, host boilerplate; repeats against plain windows."""

import random
from collections import defaultdict

import pytest

from commentguard.llm.pages import LONG, blocks_of, extract_pages, main_texts, repeats

ARTICLE = "<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav>@<footer>(c) x</footer></body></html>"


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<article><h1>A &amp; B</h1><p>one<b>two</b> <i>three</i><br>four\n\t five</p></article>", "A & B\nonetwo three four five"),
        ("<article><p>x<p>y<ul><li>z<li>&#233;&lt;b&gt;&nbsp;w</ul></article>", "x\ny\nz\né<b> w"),
        ("<main><div class='ad'>buy</div><p>kept</p><section id=comments><article>me too</article></section></main>", "kept"),
        ("<div class='cookie-notice'>ok?</div><article><p>a<script>var t='</p>';</script>b</p><form>mail</form></article>", "ab"),
        ("<article><!-- <p>no</p> --><p title='a>b'>yes</p><aside>side</aside><p hidden>h</p></article>", "yes"),
        ("<p>plain <a href=y>link</a> page with its text</p><ul><li><a href=1>menu</a></li></ul>", "plain link page with its text"),
        ("<article><p>unclosed <b>bold<br><p>next</article>after", "unclosed bold\nnext"),
        ("<header>top</header><article><header><h1>Title</h1></header>1 < 2 & so on</article>", "Title\n1 < 2 & so on"),
        ("<article></p></div><p>stray ends</p></span></article>", "stray ends"),
        ("", ""),
    ],
)
def test_main_text(body, want):
    assert main_texts([ARTICLE.replace('@', body)]) == [want]


def test_awkward_pages():
    assert main_texts([None, "", "<", "no markup at all", "<script>" * 3 + "x", "<!-- open", "&copy; a<b"])[3] == "no markup at all"
    deep = "<div>" * 20_000 + "text" + "</div>" * 20_000
    assert blocks_of(deep) == [(1, "text")]
    assert blocks_of("<p title=\"" + "x" * 200_000) in ([], [(1, "<p title=\"" + "x" * 200_000)])


def test_unmarked_boilerplate_goes_and_copies_stay():
    notice = "please accept all of our terms before you read on here"
    pages = [f"<body><div>{notice}</div><p>own words number {k} of this single page only</p></body>" for k in range(5)]
    assert main_texts(pages) == [f"own words number {k} of this single page only" for k in range(5)]
    copy = "<body><p>the very same page stands here twice under two different names</p></body>"
    assert main_texts([copy, copy]) == ["the very same page stands here twice under two different names"] * 2


def test_a_marked_article_loses_only_what_most_pages_share():
    quote = "a line that two of the articles happen to quote word by word"
    share = "follow us on all of the usual networks for more of this"
    pages = [f"<article><p>story {k} told once</p>{f'<p>{quote}</p>' if k < 2 else ''}<p>{share}</p></article>" for k in range(6)]
    assert main_texts(pages) == [f"story {k} told once" + (f"\n{quote}" if k < 2 else "") for k in range(6)]


def test_repeats_equal_plain_windows():
    rng = random.Random(1)
    for _ in range(40):
        streams = [[[rng.choice("abc") for _ in range(rng.randrange(1, 30))] for _ in range(rng.randrange(4))] for _ in range(rng.randrange(1, 6))]
        rows = [["|", *[t for b in blocks for t in [*b, "|"]]] for blocks in streams]
        on = defaultdict(set)
        for k, row in enumerate(rows):
            for i in range(len(row) - LONG + 1):
                on[tuple(row[i : i + LONG])].add(k)
        for row, blocks, got in zip(rows, streams, repeats(streams), strict=True):
            most = [1] * len(row)
            for i in range(len(row) - LONG + 1):
                for j in range(LONG):
                    most[i + j] = max(most[i + j], len(on[tuple(row[i : i + LONG])]))
            at = 1
            for block, own in zip(blocks, got, strict=True):
                assert list(own) == most[at : at + len(block)]
                at += len(block) + 1


def test_frame(spark):
    page = ARTICLE.replace("@", "<article><p>hot host page</p></article>")
    rows = [(k, "http://HOT.example/a", page, "x") for k in range(50)] + [(None, None, None, "x"), (7, "no url", "", None), (7, "no url", "", None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((str(r.page_id), r.text) for r in extract_pages(frame, part_bytes=1000).collect())
    assert got == sorted([(str(k), "hot host page") for k in range(50)] + [("None", ""), ("7", ""), ("7", "")])
    assert extract_pages(frame.limit(0)).count() == 0


def test_repeats_count_over_all_parts_of_a_host(spark):
    """The text of a page does not depend on the number of parts its host is dealt into."""
    notice = "please accept all of our terms before you read on here"
    share = "follow us on all of the usual networks for more of this"
    pages = [f"<body>{f'<div>{notice}</div>' if k in (3, 77) else ''}<p>{' '.join(f'own{k}x{j}' for j in range(12))}</p></body>" for k in range(80)]
    pages += [f"<article><p>{' '.join(f'story{k}x{j}' for j in range(12))}</p>{f'<p>{share}</p>' if k % 4 else ''}</article>" for k in range(240)]
    frame = spark.createDataFrame([(k, "http://h.example/", page) for k, page in enumerate(pages)], "page_id long, url string, html string")
    whole, parts = ({r.page_id: r.text for r in extract_pages(frame, part_bytes=n).collect()} for n in (10**9, 500))
    assert whole == parts == dict(enumerate(main_texts(pages)))
    assert not any(notice in t or share in t for t in parts.values())


def test_marked_hosts_count_few_windows_and_still_all_pages(spark):
    """Hosts of marked pages only: shares just above and below half of the pages, in any deal, and equal rows."""
    often, seldom = "one notice on a little more than half of all pages", "another notice on a little less than half of the pages"
    pages = [
        f"<article><p>{' '.join(f'story{k}x{j}' for j in range(12))}</p>{f'<p>{often}</p>' if k % 9 < 5 else ''}"
        f"{f'<p>{seldom}</p>' if k % 9 > 4 else ''}</article>" for k in range(180)
    ]
    pages += [pages[0]] * 10 + [""]
    frame = spark.createDataFrame([(k, f"http://h{k // 300}.example/", page) for k, page in enumerate(pages)], "page_id long, url string, html string")
    whole, parts = ({r.page_id: r.text for r in extract_pages(frame, part_bytes=n).collect()} for n in (10**9, 900))
    assert whole == parts == dict(enumerate(main_texts(pages)))
    assert not any(often in t for t in parts.values()) and sum(seldom in t for t in parts.values()) == 80


def test_blocks_lose_only_their_shared_runs():
    words = lambda name, n: " ".join(f"{name}{j}" for j in range(n))
    shared = words("same", 85)
    pages = [f"<body><p>{shared} {words(f'own{k}x', 15)}</p></body>" for k in range(2)]
    assert main_texts(pages) == [words(f"own{k}x", 15) for k in range(2)]
    pages = [f"<article><p>{words(f'a{k}x', 30)} {shared} {words(f'b{k}x', 30)}</p></article>" for k in range(5)]
    assert main_texts(pages) == [f"{words(f'a{k}x', 30)} {words(f'b{k}x', 30)}" for k in range(5)]


@pytest.mark.parametrize("size", [100, 5_000, 1_000_000])
def test_attributes_of_any_length(size):
    long = "x" * size
    assert blocks_of(f'<p title="{long}>y">hello world</p>') == [(1, "hello world")]
    assert blocks_of(f"<img src = '{long}>'><p>a</p>") == [(1, "a")]
    assert blocks_of(f'<p title="{long}>open</p><p>next</p>') == [(1, "open"), (1, "next")]  # a quote that nothing closes


def test_quotes_inside_unquoted_values():
    assert blocks_of("<p data-a=it's>one</p><p>it's two</p>") == [(1, "one"), (1, "it's two")]
    assert blocks_of("<p 'odd>one</p><p>two'</p>") == [(1, "one"), (1, "two'")]
