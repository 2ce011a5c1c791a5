import random

from medialoom.llm import wrappers as W

PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul>{menu}</ul></nav><!-- x --><div class="ad">buy</div>
<div class="cookie-notice">we use cookies</div><div id="story"><h2>{title}</h2><p>{a}<br><p>{b} &amp; more<div class="share-bar">share</div>{rest}<section class="comments"><p>nice!</p></section></div>
<aside>see also</aside><form><p>search</p></form><footer>&copy; 2024</footer></body></html>"""


def page(i, n):
    return PAGE.format(menu="".join(f"<li><a href=x>m{k}</a></li>" for k in range(n + 2)), title=f"Title {i}", a=f"First  {i}\n part", b=f"Second {i}", rest="".join(f"<p>More {i} {k}" for k in range(n)))


def want(i, n):
    return "\n".join([f"Title {i}", f"First {i} part", f"Second {i} & more", *(f"More {i} {k}" for k in range(n))])


def test_wrapper_finds_the_article():
    reader = W.Reader()
    key = W.infer(reader, [page(i, i % 3) for i in range(5)])
    assert key == "div.story"
    for i in range(7):
        assert W.read(reader, page(i, i), key) == want(i, i)


def test_the_article_may_have_any_name():
    """Classes say nothing, and what is called article holds teasers."""
    rng = random.Random(4)
    text = lambda n: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))
    pages, wants = [], []
    for i in range(12):
        parts = [text(30) for _ in range(2 + i % 3)]
        teasers = "".join(f'<article class="q{k}"><a href="/{k}">{text(4)}</a></article>' for k in range(3 + i % 2))
        pages.append(f'<html><body><div class="x1"><ul>{"".join(f"<li>{text(1)}</li>" for _ in range(4))}</ul></div><div class="x2">{teasers}</div><div class="x3"><h1>{parts[0]}</h1>{"".join(f"<p>{p}</p>" for p in parts[1:])}</div><div class="x4"><p>always the same words at the foot</p></div></body></html>')
        wants.append("\n".join(parts))
    reader = W.Reader()
    key = W.infer(reader, pages[:6])
    assert key == "div.x3" and [W.read(reader, p, key) for p in pages] == wants
    assert W.read(reader, pages[3], None) == wants[3]


def test_alignment_makes_slots_options_and_repeats():
    reader = W.Reader()
    a, b = (W.folded(W.stream(reader, p)) for p in ("<ul><li>x</li><li>y</li></ul><b>same</b><p>one</p>", "<ul><li>z</li><li>u</li><li>v</li></ul><b>same</b><i>opt</i><p>two</p>"))
    w = W.align(a, b)
    assert ("rep", [("tag", "li"), ("text", None), ("tag", "/li")]) in w
    assert ("opt", [("tag", "i"), ("text", "opt"), ("tag", "/i")]) in w and ("text", "same") in w and ("text", None) in w


def test_odd_pages():
    reader = W.Reader()
    assert W.read(reader, None, "article") == W.read(reader, "", "") == W.read(reader, "<nav>x</nav>", None) == ""
    assert W.read(reader, "plain words &lt;b&gt;", None) == "plain words <b>"
    assert W.read(reader, "<article><p>a<p>b", "article") == "a\nb"
    assert W.read(reader, "<article>x <script>y</script>z < 3</article>", "article") == "x z < 3"
    long = "<article>" + "<p>word word</p>" * 20000 + "</article>"
    assert W.read(reader, long, "article").count("\n") == 19999


def test_main_text(spark):
    rows = [(i, f"http://a.example/{i}", page(i, i % 4)) for i in range(12)] + [(50, "http://b.example/x", "<html><body><article><p>only one</p></article></body></html>"), (51, None, None), (52, "http://a.example/0", ""), (53, None, page(3, 1)), (54, "http://a.example/9", page(9, 1)), (54, "http://a.example/9", page(9, 1))]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, host string")
    got = W.main_text(spark, df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert all(by[i].text == want(i, i % 4) and by[i].n_chars == len(want(i, i % 4)) for i in range(12))
    assert by[50].text == "only one" and by[51].text == by[52].text == "" and by[53].text == want(3, 1)
    assert W.main_text(spark, df.limit(0)).count() == 0


def test_every_page_of_a_host_counts(spark):
    """Eight pages that have one short text, and one page whose article outweighs them: whichever pages a few would be."""
    short = [(i, f"http://a.example/{i}", f"<html><body><div class=lead><p>n {i}</p></div></body></html>") for i in range(24)]
    long = [(100, "http://a.example/long", "<html><body><div class=lead><p>n</p></div><div class=story><p>" + "words of it " * 60 + "</p></div></body></html>"), (101, "http://a.example/long2", "<html><body><div class=lead><p>n</p></div><div class=story><p>" + "other words " * 60 + "</p></div></body></html>")]
    df = spark.createDataFrame(short + long, "page_id bigint, url string, html string").repartition(4)
    assert [r.article for r in W.host_wrappers(df).collect()] == ["div.story"]
    reader = W.Reader()
    parts = [W.Learned() for _ in range(3)]
    for k, (_, _, html) in enumerate(short + long):
        parts[k % 3].add(W.stream(reader, html))
    whole = W.Learned()
    for x in parts:
        whole.merge(x)
    assert whole.article() == W.infer(reader, [r[2] for r in short + long]) == "div.story"
    same = W.Learned()
    same.merge(parts[0].__class__())
    assert same.article() == ""


def test_articles_after_thousands_of_tags():
    reader = W.Reader()
    menu = "<div class=list>" + "".join(f"<span class=c{'abc'[k % 3]}{'de'[k % 5 % 2]}><a href=x>link {k}</a></span>" for k in range(1500)) + "</div>"
    long = [f"<html><body>{menu}<div class=story><p>First {i}</p><p>Second {i}</p>{'<p>More</p>' * i}</div></body></html>" for i in range(3)]
    assert W.infer(reader, long) == "div.story"
    named = f"<html><body>{menu}<article><p>words of it</p></article></body></html>"
    assert W.read(reader, named, None) == "words of it"


def test_halved_alignment_is_as_good(monkeypatch):
    rng = random.Random(5)
    some = lambda: [rng.choice([("tag", "a"), ("tag", "b"), ("tag", "/a"), ("text", "x"), ("text", "y")]) for _ in range(rng.randint(5, 40))]
    common = lambda w: sum({"tag": 3, "text": 2}.get(k, 0) for k, _ in w)
    for _ in range(50):
        a, b = some(), some()
        monkeypatch.setattr(W, "CELLS", 1 << 18)
        whole = W.align(a, b)
        monkeypatch.setattr(W, "CELLS", 20)
        assert common(W.align(a, b)) == common(whole)
