import sys
import time

from pyspark.sql import functions as F

from stratalog.llm import wrappers as w

PAGES = "page_id long, url string, html string"


def page(i, body, host="h.example.com"):
    return (i, f"https://{host}/p/{i}", f'<!DOCTYPE html><html><head><title>T{i}</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/a">Menu {i}</a></li><li>b</li></ul></nav><div class="ad">buy {i}</div><article>{body}</article><footer>&copy; all</footer></body></html>')


def texts(spark, rows):
    return {r.page_id: r.text for r in w.extract(spark.createDataFrame(rows, PAGES)).collect()}


def test_articles(spark):
    rows = [page(i, f"<h1>Head {i}</h1>" + "".join(f"<p>Para <b>{k}</b>th &amp; more\n text</p>" for k in range(i % 4 + 1))) for i in range(9)]
    got = texts(spark, rows)
    assert got[0] == "Head 0 Para 0th & more text" and got[3].startswith("Head 3 Para 0th & more text Para 1th") and got[3].count("Para") == 4


def test_equal_articles_stay_and_parts_go(spark):
    rows = [page(i, "<header><h1>Same</h1></header><p>equal text</p><aside>x</aside><div class='comments'><p>c</p></div><form>f</form><!-- no --><noscript>n</noscript>") for i in range(5)]
    assert set(texts(spark, rows).values()) == {"Same equal text"}


def test_pages_without_article(spark):
    rows = [(i, f"http://plain.example/{i}", f"<header>Site</header><div id=menu class=menu>m</div><div><p>Body {i}<p>second<br>line {i}</div><div>Fixed words</div><div class='sidebar'>s</div>") for i in range(4)]
    assert texts(spark, rows) == {i: f"Body {i} second line {i}" for i in range(4)}


def test_edge_rows(spark):
    rows = [(1, None, None), (2, "https://e.example/", ""), (3, "x", "plain text & so"), (4, "https://e.example/b", "<article><p>open <b>and &lt;never</article"), (4, "https://e.example/b", "<article><p>open <b>and &lt;never</article"), (5, "https://e.example/", "<div>" * 3000 + "deep"), (6, "https://e.example/", "<script>only"), (7, "https://e.example/", "<p title='x>y'>q</p><![CDATA[z]]><?php ?>")]
    df = spark.createDataFrame(rows, PAGES).withColumn("host", F.lit("mine")).withColumn("tree", F.lit(1))
    got = [(r.page_id, r.text, r.n_chars) for r in w.extract(df).collect()]
    assert len(got) == len(rows) and all(n == len(t) for _, t, n in got)
    by = dict((a, b) for a, b, _ in got)
    assert by[1] == "" and by[2] == "" and by[3] == "plain text & so" and by[4] == "open and <never" and by[5] == "deep" and by[6] == "" and by[7] == "q"
    assert w.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_wrapper_has_optional_and_repeated_groups():
    a, b = (w.skeleton(w.parse(x)) for x in ("<ul><li>a<li>b</ul><p>x</p>", "<ul><li>a</ul><i>y</i><p>z</p>"))
    assert w.shape(w.merge(a, b)) == "root (ul (li +(#)),i ?(#),p (#))"
    again = w.load(w.dump(w.merge(a, b)))
    assert w.shape(w.merge(again, a)) == w.shape(again)


def test_copies_and_siblings_are_no_sightings(spark):
    one = "<div><p>only text</p></div>"
    rows = [(i, f"http://copies.example/{i}", one) for i in range(4)]
    rows += [(10 + i, f"http://some.example/{i}", f"<div><p>own words {i}</p></div>") for i in range(4)]
    rows += [(20 + i, "http://some.example/x", "<div><p>own words x</p></div><section>rare block</section>") for i in range(3)]
    rows += [(30 + i, f"http://few.example/{i}", f"<div>own {i}</div>" + "<section>three of ten</section>" * (i < 3)) for i in range(10)]
    rows += [(40, "http://single.example/", "<div>" + "<p>again</p>" * 3 + "</div>")]
    got = texts(spark, rows)
    assert {got[i] for i in range(4)} == {"only text"} and {got[i] for i in (20, 21, 22)} == {"own words x rare block"}
    assert got[30] == "own 0 three of ten" and got[35] == "own 5" and got[40] == "again again again"


def test_below_the_deepest_level_end_tags_match_and_parts_stay_out():
    deep = lambda tag, inner: f"<{tag}>" * 400 + inner + f"</{tag}>" * 400
    read = lambda x: " ".join(w.Wrapper(None, 1).blocks(w.parse(x)))
    parts = "in<nav>menu <div>links</div></nav><div class='comments'><p>c</p></div><form>f</form><div>a</div>b<b>c</b>"
    assert read(f"<div><article>{deep('div', parts)}<p>after</p></article></div><p>end</p>") == "in a bc after"
    assert read(deep("div", f"x<header>h</header><article>{parts}</article>y") + "z") == "in a bc"
    assert read("<article>" + "<font>" * 300 + parts + "</article>after") == "in a bc"
    assert read("<div>" * 100_000 + "</b>" * 100_000 + "deep") == "deep"


def test_the_wrapper_tells_menus_in_articles(spark):
    tools = "<ul><li><a href='/s'>Send</a></li> <li><a href='/p'>Print</a></li></ul>"
    rows = [page(i, f"<h2><a href='/t'>Same head</a></h2><p>Own text {i}</p>{tools}<p>Same words.</p><ol><li><a>Source {i}</a></li></ol>") for i in range(6)]
    rows += [page(10 + i, f"<p>Own text {i}</p>{tools}", "two.example.com") for i in range(2)]
    rows += [page(20 + i, f"<p>Own text</p>{tools}", "copies.example.com") for i in range(5)]
    rows += [page(30 + i, f"<p>Own text {i}</p>" + tools * (i < 3), "few.example.com") for i in range(10)]
    rows += [page(50 + i, f"<p>Own text {i}</p>{tools.replace('</ul>', '<li>by hand</li></ul>')}", "words.example.com") for i in range(5)]
    got = texts(spark, rows)
    assert all(got[i] == f"Same head Own text {i} Same words. Source {i}" for i in range(6))
    assert got[10] == "Own text 0 Send Print" and got[20] == "Own text Send Print" and got[30] == "Own text 0 Send Print" and got[50] == "Own text 0 Send Print by hand"


def test_all_pages_are_counted_not_a_draw(spark):
    """Half of 101 pages and one less; copies in other markup are no sightings."""
    both = "<section>half of all</section>"
    rows = []
    for h in range(5):
        for i in range(101):
            rows.append((h * 1000 + i, f"http://half{h}.example/{i}", f"<div>own {h} {i}</div>" + both * (i < 51)))
            rows.append((10_000 + h * 1000 + i, f"http://less{h}.example/{i}", f"<div>own {h} {i}</div>" + both * (i < 50)))
        rows += [(20_000 + h * 1000 + i, f"http://less{h}.example/{i}", f"<div><span>own {h} {i}</span></div>" + both) for i in range(20)]
    got = texts(spark, rows)
    for h in range(5):
        assert all(got[h * 1000 + i] == f"own {h} {i}" for i in range(101))
        assert all(got[10_000 + h * 1000 + i] == f"own {h} {i}" + " half of all" * (i < 50) for i in range(101))
        assert all(got[20_000 + h * 1000 + i] == f"own {h} {i} half of all" for i in range(20))


def calls(f):
    """The result of f and how many Python functions it called."""
    n = 0

    def count(frame, event, arg):
        nonlocal n
        n += event == "call"

    sys.setprofile(count)
    try:
        out = f()
    finally:
        sys.setprofile(None)
    return out, n


def test_a_page_takes_few_calls_a_tag():
    """Both passes read every page, so a call for each tag is a second for some hundred thousand tags."""
    body = "".join(f"<h2>Head {i}</h2><p>Some <b>bold</b> words<br> &amp; more</p><ul><li><a href='/{i}'>x</a></li> <li>y</li></ul>" for i in range(50))
    html = f"<html><body><nav class=menu><a href='/'>m</a></nav><article>{body}</article></body></html>"
    tags = html.count("<")
    parsed, n = calls(lambda: w.parse(html))
    assert n < 3 * tags
    tree, n = calls(lambda: w.skeleton(parsed))
    assert n < 5 * tags and w.shape(tree).count("li +") == 50
    got, n = calls(lambda: w.Wrapper(tree, 1).blocks(parsed))
    assert n < 5 * tags and len(got) == 50 * 5


def test_a_long_name_is_read_once():
    start = time.process_time()
    for end in ("", " 'open>", '" b">'):
        w.parse("<" + "a" * 30_000 + end)
    assert time.process_time() - start < 5
    assert [k.tag for k in w.parse("""<a"b c"d><i'j k>l</i'j>""").kids] == ["a"]
    assert w.parse("""<a"b c"d>x""").kids[0].kids[0].text == "x" and w.parse("""<i'j>x</i'j>y""").kids[1].text == "y"
