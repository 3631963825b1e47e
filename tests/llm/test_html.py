import random
from itertools import accumulate

from kanasift.llm import html

PAGE = """<!DOCTYPE html><html><head><title>No title</title><style>p{{}}</style></head><body><header><a href="/">Site name</a></header>
<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav><div class="cookie-notice">We use cookies here, do accept all of them</div>
<!-- <p>not this</p> --><div class="ad">Buy this now</div>{open}<h1>A &amp; B</h1><p>First   paragraph
goes on<br>here.<p>Unclosed <b>bold <i>text</b> ends.<div class="ad banner">More adverts</div><ul><li>item one</li><li>item two</ul>
<p>Short.</p><script>var x = "<p>";</script><form><label>Mail</label><input><button>Send</button></form><p>Tail é &#233; &lt;x&gt; &copy;</p>{close}
<section id="comments"><p>Great post, I read it all!</p><p>No it was not great at all.</p></section><aside><p>Related stories are here</p></aside><footer>&copy; me</footer></body></html>"""
TEXT = "A & B\nFirst paragraph goes on here.\nUnclosed bold text ends.\nitem one\nitem two\nShort.\nTail é é <x> ©"


def labelled():
    return [PAGE.format(open="<article>", close="</article>").replace("paragraph", f"paragraph {'word ' * k}") for k in range(20)]


def test_main_text():
    w = html.fit(labelled())
    assert html.main_text(PAGE.format(open="<article>", close="</article>"), w) == TEXT
    assert html.main_text(PAGE.format(open="<main id=x>", close="</main>"), w) == TEXT
    for page in (None, "", "   ", "<html></html>", "<nav>only menu</nav>", "<!--", "<p", "<script>x"):
        assert html.main_text(page, w) == ""
    assert html.main_text("<article><p>cut off he", w) == "cut off he" and html.main_text("<article><p>cut &am", w) == "cut &am"
    assert html.main_text("<article><p>a</p><p>b <scr", w) == "a\nb"
    assert html.main_text("<article>" + "<div>" * 3000 + "<p>deep</p>" + "<p>x y z</p>" * 3000, w).count("\n") == 3000
    assert html.main_text("plain text only", w) == "plain text only"


def test_held_out_pages_without_the_label():
    # Weights of labelled pages hold on pages whose main text no element marks: half of the pages are held out.
    pages = labelled()
    w = html.fit(pages[:10])
    for page in pages[10:]:
        bare = html.main_text(page.replace("article>", "div>"), w)
        want = html.main_text(page, w)
        assert set(want.split("\n")) - set(bare.split("\n")) <= {"item one", "item two"} and "Great post" not in bare and "cookies" not in bare


def test_region_is_the_largest_sum():
    rng = random.Random(0)
    for _ in range(300):
        items = [html.Item("p" if rng.random() < 0.5 else "", rng.choice(["", "nav"]), False, k, None if rng.random() < 0.5 else "w " * rng.randint(0, 3)) for k in range(rng.randint(0, 12))]
        w = html.Weights({("", ""): 1.0, ("nav", ""): -1.5}, {("p", ""): -0.7})
        scores = [w.tags.get((i.tag, ""), -0.3) if i.text is None else w.words[i.kind, ""] * len(i.text.split()) for i in items]
        sums = [0.0, *accumulate(scores)]
        best = max((sums[j] - sums[i] for i in range(len(sums)) for j in range(i, len(sums))), default=0)
        lo, hi = html.region(items, w)
        assert abs(sums[hi] - sums[lo] - best) < 1e-9


def test_extract(spark):
    pages = [(k, f"u{k}", p) for k, p in enumerate(labelled())] + [(90, None, None), (91, "u", ""), (0, "u0", labelled()[0])]
    out = html.extract(spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, text int")).collect()
    assert len(out) == len(pages) and {r["page_id"]: r["text"] for r in out}[0] == TEXT.replace("paragraph", "paragraph")
    assert all(r["n_chars"] == len(r["text"]) for r in out)
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_wrappers_and_visible_elements_keep_their_text():
    w = html.fit(labelled())
    story = "<article><p>The whole story stands here.</p></article>"
    for attributes in ('class="content-sidebar-wrap"', 'class="has-sidebar"', 'class="header-image"', 'id=bottom', 'class="share"', 'class="layout tabs"', 'role="form"', 'class="promo"><div class="widget"', 'aria-hidden="false"', "aria-hidden='false'", 'hidden="false"', 'data-hidden="x"'):
        page = f'<body><nav>Home page</nav><div {attributes}>{story}</div><div class="comments"><article>Nice read, thanks</article></div></body>'
        assert html.main_text(page, w) == "The whole story stands here.", attributes
    assert html.main_text(f"<form action=x>{story}</form>", w) == "The whole story stands here."
    for attributes in ('hidden', 'hidden=""', 'aria-hidden="true"', 'style="display: none"'):
        assert html.main_text(f"<article><p>Seen by all.</p><div {attributes}>not seen</div></article>", w) == "Seen by all.", attributes
    assert html.main_text('<article><p>Seen by all.</p><p aria-hidden="false">So is this.</p></article>', w) == "Seen by all.\nSo is this."
    # Without such an element, a wrapper with most of the plain words is spared, a real sidebar is not.
    long = "<p>" + "many plain words stand here " * 20 + "</p>"
    out = html.main_text(f'<body><div class="has-sidebar">{long}<div class="sidebar"><p>Other stories</p></div></div></body>', w)
    assert out.startswith("many plain words") and "Other" not in out


def test_odd_quotes():
    w = html.fit(labelled())
    for attributes in ("class=don't", "title=\"it's\" id='a\"b'", "data-x='", 'data-x="', "'", '"', "a='1'b=\"2\"", "x= 'a > b'"):
        out = html.main_text(f"<article><p {attributes}>Hello there.</p><p>Second one.</p></article>", w)
        assert out == "Hello there.\nSecond one.", attributes
    assert html.main_text("<article><p " + "=' " * 20000 + ">x</p></article>", w) in ("x", "")


def test_nothing_inside_an_article_falls_to_a_layout_word():
    w = html.fit(labelled())
    for attributes in ("class='bottom'", "class='discussion'", "class='search-results-analysis'", "id=header", "class=rail", "class='tabs'", "role=search"):
        assert html.main_text(f"<article><p>One two three.</p><div {attributes}>Kept text here</div></article>", w) == "One two three.\nKept text here", attributes
    assert html.main_text("<article><h1 class='header'>Title</h1><p>One two three.</p></article>", w) == "Title\nOne two three."


def test_comments_weigh_below_zero_wherever_they_stand():
    w = html.fit(labelled())
    assert all(w.words[kind, place] < 0 for kind in ("comment", "ad", "nav", "footer", "notice") for place in ("", "in", "out"))
    for name in ("comments", "ad"):
        page = f"<article><p>One two three.</p></article><section><p>teaser of another story</p></section><div class='{name}'>{'many words ' * 100}</div>"
        assert html.main_text(page, w) == "One two three."
    second = "<p>" + "Second article text. " * 10 + "</p>"
    page = f"<article><p>One two three four five.</p></article><div><ul>{'<li><a href=x>menu item here</a></li>' * 60}</ul></div><article>{second}</article>"
    assert html.main_text(page, w) == "One two three four five.\n" + ("Second article text. " * 10).strip()


def test_the_scan_removes_unnamed_parts_of_held_out_pages():
    """Pages without an article element whose menu, advert, comments and footer have no telling names: the scan alone decides."""
    rng = random.Random(13)
    some = lambda n: " ".join(rng.choices(["word", "text", "story", "and", "of"], k=n))

    def page(mark):
        menu = "".join(f"<li><a href='/{k}'>{some(2)}</a></li>" for k in range(rng.randint(4, 12)))
        story = [some(rng.randint(5, 9)) + " title"] + [some(rng.randint(8, 60)) + "." for _ in range(rng.randint(2, 7))]
        notes = "".join(f"<div><div>{some(1)}</div><div>{some(rng.randint(2, 6))}</div></div>" for _ in range(rng.randint(0, 4)))
        n = ("nav", "article", "ad", "comments", "footer") if mark else ("div", "div", "k1", "k2", "div")
        body = f"<{n[0]}><ul>{menu}</ul></{n[0]}><div class={n[2]}>{some(8)}</div><{n[1]}><h1>{story[0]}</h1>" + "".join(f"<p>{p}</p>" for p in story[1:]) + f"</{n[1]}><div class={n[3]}>{notes}</div><{n[4]}>{some(6)}</{n[4]}>"
        return f"<html><body>{body}</body></html>", "\n".join(story)

    w = html.fit([page(True)[0] for _ in range(60)])
    removed = 0
    for _ in range(100):
        bare, want = page(False)
        assert html.main_text(bare, w) == want
        items = html.parse(bare)
        lo, hi = html.region(items, w)
        removed += sum(i.text is not None and i.kind in ("", "link") for i in items[:lo] + items[hi:])
    assert removed > 500


def test_weights_fitted_in_tasks_equal_those_fitted_at_once(spark):
    pages = labelled()
    df = spark.createDataFrame([(k, f"u{k}", p) for k, p in enumerate(pages)] + [(3, "again", pages[3]), (50, "u", None), (51, "u", "no label")], "page_id long, url string, html string")
    assert html.train(df) == html.fit(pages)
