import random
import time
from collections import Counter

import odd_pages

from paperloom.llm import html_text as h

PAGE = """<!DOCTYPE html><html><head><title>T</title></head><body class="no-sidebar"><header class="site-header"><a href="/">Home</a> Site name here</header>
<nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav><div id="cookie-notice">We use cookies to improve your experience, please accept.</div>
<div class="ad">Buy the best thing now</div>{open}<h1>The  title</h1><p>First paragraph with <b>bo</b>ld text &amp; more &#233;.<p>Second one<br>goes on&nbsp;here for a while.
<aside>Related: read that too</aside><div class="advert">Buy it now</div><ul><li>point one is here<li>point two is here</ul><form>Mail <input> Send</form>
<p>Third paragraph ends it, with "a < b" in words.</p>{close}<div class="comments"><p>Reader says that this is a great article and writes many words about it.</p></div>
<footer>&copy; 2020 all rights</footer><script>var a="<p>no</p>"</script></body></html>"""
TEXT = """The title\n\nFirst paragraph with bold text & more é.\n\nSecond one goes on here for a while.\n\npoint one is here\n\npoint two is here\n\nThird paragraph ends it, with "a < b" in words."""


def pages(spark, n=60):
    draw = random.Random(1)
    words = lambda m: " ".join(draw.choice(["some", "word", "here", "and", "there"]) for _ in range(m))
    rows = []
    for k in range(n):
        inner = "".join(f"<p>{words(draw.randrange(2, 40))}</p>" for _ in range(draw.randrange(1, 5)))
        nav = "<nav>" + "".join(f"<li><a href=x>{words(1)}</a></li>" for _ in range(8)) + "</nav>"
        rows.append((k, f"u{k}", f'<html><body>{nav}<div class="box7">{words(6)}</div><article>{inner}</article><footer>{words(12)}</footer></body></html>'))
    return rows


def test_article_with_and_without_its_element(spark):
    weights = h.learn(spark.createDataFrame(pages(spark), "page_id long, url string, html string"))
    assert weights.word > 0 and all(w < 0 for w in weights.tags.values())
    assert h.main_text(PAGE.format(open="<article>", close="</article>"), weights) == TEXT
    assert h.main_text(PAGE.format(open='<div class="content">', close="</div>"), weights) == TEXT
    assert weights.never(("div", "div.box7"))  # learned: it never stands in the main text


def test_best_run_equals_brute_force():
    draw = random.Random(2)
    for _ in range(2000):
        s = [draw.randrange(-5, 6) for _ in range(draw.randrange(9))]
        a, b = h.best_run(s)
        best = max([0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1))])
        assert sum(s[a:b]) == best


def test_odd_pages():
    w = h.Weights(word=5.0)
    assert [h.main_text(p, w) for p in (None, "", "plain words only", "<p", "<<<>>", "<p>a<p class='ad'>b<p>c")] == ["", "", "plain words only", "<p", "<<<>>", "a\n\nc"]
    assert h.main_text("<nav>only a menu</nav>", w) == ""
    start = time.perf_counter()
    for hard in ("<a " * 100_000 + '"', "<script>" * 30_000, "<div>" * 20_000 + "x" + "</b>" * 20_000, "<!--" * 30_000, "&" * 100_000):
        h.main_text(hard, w)
    assert time.perf_counter() - start < 20


def test_elements_without_text_end_where_they_should():
    w = h.Weights(word=5.0)
    story = "<article><p>One two three.{}</p><p>Four five six.</p></article><p>Seven eight.</p>"
    whole = "One two three.\n\nFour five six.\n\nSeven eight."
    assert h.main_text("<html><head><title>T</title><body>" + story.format(""), w) == whole
    assert h.main_text("<html><head><meta charset=utf-8><title>T</title>" + story.format(""), w) == whole
    assert h.main_text("<head><title>T" + story.format(""), w) == whole
    assert h.main_text("<head><title>T</title>Plain text.", w) == "Plain text."
    for part in ('<svg width="1" />', "<svg/>", "<svg><title>no</title><path d=x /><g/></svg>", "<object data=x />", "<button>", "<object data=x>", "<video src=x>"):
        assert h.main_text(story.format(part), w).startswith("One two three."), part
        assert h.main_text(story.format(part), w).endswith("Four five six.\n\nSeven eight."), part
        assert h.main_text("<article><p>One.</p>" + part + "<p>Two.</p></article>", w) == "One.\n\nTwo.", part
    for part in ("<button>no</button>", "<select><option>no<option>no</select>", "<noscript>no</noscript>", "<script>no <p></script>", "<svg><text>no</text></svg>"):
        assert h.main_text(story.format(part), w) == whole, part
    formula = "<math><mrow><mi>x</mi><mo>=</mo>" + "<mspace/>" * 200 + "<mn>2</mn></mrow></math>"
    assert h.main_text(f"<p>If {formula} then.</p>", h.Weights()) == "If x=2 then."


def test_dropped_blocks_in_an_article_do_not_cut_it():
    one, two = "one " * 40, "two " * 60
    links = "".join(f"<li><a href=/{k}>read this too</a></li>" for k in range(30))
    for block in (f'<ul class="related">{links}</ul>', f"<aside><ul>{links}</ul></aside>", f'<div class="share"><ul>{links}</ul></div>'):
        page = f"<article><p>{one}</p>{block}<p>{two}</p></article>"
        assert h.main_text(page, h.Weights()) == one.strip() + "\n\n" + two.strip()


def test_names_of_headings_and_wrappers_do_not_drop_them():
    w = h.Weights(word=5.0)
    text = "one two three " * 5
    headings = '<h2 id="related-work">Related work</h2><p class="notice">{0}</p><h2 id="social-impact">Impact</h2><h3 id="menu-design">Menus</h3>'
    whole = "Related work\n\n{0}\n\nImpact\n\nMenus".format(text.strip())
    assert h.main_text("<article>" + headings.format(text) + "</article>", w) == whole
    assert h.main_text('<article><section id="related-work">' + headings.format(text) + f"</section><p>{text}</p><p>{text}</p></article>", w).startswith(whole)
    for wrapper in ('<div class="widget-content">', '<div class="widget"><div class="widget-content">'):
        assert h.main_text(f'{wrapper}<article>{headings.format(text)}</article></div></div><div class="ad">Buy it</div>', w) == whole
    for block in ('<div id="cookie-notice">no no</div>', '<div id="related-posts">no no</div>', '<ul class="share-links">no no</ul>', '<div id="ad-1">no</div>'):
        assert h.main_text("<article>" + headings.format(text) + block + "</article>", w) == whole


def test_edge_cases(spark):
    rows = [*pages(spark, 5), (None, None, None), (7, "u", ""), (1, "u1", pages(spark, 5)[1][2]), (8, "u", "<p>" + "word " * 50_000)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    found = h.extract(frame).collect()
    assert len(found) == len(rows) and all(r.n_chars == len(r.text) for r in found)
    by_id = {r.page_id: r for r in found}
    assert by_id[None].text == by_id[7].text == "" and by_id[8].n_chars == 249_999
    assert h.extract(frame.limit(0)).count() == 0


def agreement(weights):
    """Pages whose text is as wanted, and precision and recall of their blocks."""
    right, kept, wanted, both = [], 0, 0, 0
    for name, (page, text) in odd_pages.PAGES.items():
        found = h.main_text(page, weights)
        if found == text:
            right.append(name)
        a, b = Counter(found.split("\n\n") if found else []), Counter(text.split("\n\n") if text else [])
        kept, wanted, both = kept + a.total(), wanted + b.total(), both + (a & b).total()
    return right, both / kept, both / wanted


def test_odd_pages_with_learned_and_with_fixed_weights(spark):
    learned = h.learn(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    for weights in (learned, h.Weights()):
        right, precision, recall = agreement(weights)
        assert set(odd_pages.PAGES) - set(right) == set()
        assert precision == recall == 1.0


def test_copies_of_one_page_are_one_page_of_the_sample(spark, monkeypatch):
    rows = spark.createDataFrame(pages(spark, 20), "page_id long, url string, html string")
    copies = rows.where("page_id < 2").crossJoin(spark.range(2000)).select("page_id", "url", "html")
    one, many = h.learn(rows), h.learn(rows.unionAll(copies))
    assert (one.word, one.linked, one.tags) == (many.word, many.linked, many.tags)
