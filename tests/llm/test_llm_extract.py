import itertools
import random
import time

import pytest

from threadshelf.llm import extract


@pytest.fixture(scope="module")
def model():
    return extract.fit([extract.PageMaker(extract.SEED * 1_000_003 + i).page() for i in range(300)])


def test_accuracy_on_pages_not_seen(model):
    right = wrong = exact = 0
    pages = [extract.PageMaker(555_000_000 + i).page() for i in range(200)]
    for page, article in pages:
        blocks = extract.leaf_blocks(page)
        found = model.decode(blocks)
        wanted = set(article)
        right += sum((b.text in wanted) == f for b, f in zip(blocks, found))
        wrong += sum((b.text in wanted) != f for b, f in zip(blocks, found))
        exact += extract.article_text(page, model) == "\n".join(article)
    assert right / (right + wrong) > 0.98 and exact / len(pages) > 0.85


def test_viterbi_is_the_best_of_all_paths():
    r = random.Random(1)
    blocks = extract.leaf_blocks("".join(f"<p>t{i} is here.</p><div>x{i}</div>" for i in range(5)))
    for _ in range(10):
        names = {f for i, b in enumerate(blocks) for f in (*b.path, *extract.text_features(b, i, len(blocks)))}
        m = extract.Model({f: r.uniform(-2, 2) for f in names}, [[r.uniform(-1, 1) for _ in "ab"] for _ in "ab"], [r.uniform(-1, 1) for _ in "ab"])
        score = [sum(m.weights[f] for f in (*b.path, *extract.text_features(b, i, len(blocks)))) for i, b in enumerate(blocks)]

        def total(path):
            moves = sum(m.moves[a][b] for a, b in zip(path, path[1:]))
            return m.start[path[0]] + moves + sum(s for s, y in zip(score, path) if y)

        best = max(itertools.product([0, 1], repeat=len(blocks)), key=total)
        assert m.decode(blocks) == [bool(x) for x in best]


def test_blocks():
    text = lambda page: [b.text for b in extract.leaf_blocks(page)]
    assert text("<p>a &amp; b\n  c<br>d<p>e<i>f</i>g</p>h") == ["a & b c d", "efg", "h"]
    assert text("<script>var t='<p>x</p>';</script><style>p{}</style><!-- <p>no</p> -->yes") == ["yes"]
    assert text("<ul><li>1<li>2</ul><table><tr><td>3<td>4</table>") == ["1", "2", "3", "4"]
    assert text('<a title="x > y">z</a> 1 < 2 &lt;b&gt; &nbsp; &#233;') == ["z 1 < 2 <b> é"]
    assert text("") == [] and text("<div><p></p></div>") == [] and text("<!-- open") == [] and text("<script>open") == []
    linked = extract.leaf_blocks("<li><a href=/>all</a></li><li>none of it</li>")
    assert [b.linked for b in linked] == [1.0, 0.0]
    assert extract.leaf_blocks('<div class="Side-Bar x1" id=main><p>t</p></div>')[0].path == frozenset(
        {"in:div", "in:p", "is:side", "is:bar", "is:x", "is:main"}
    )


def test_markup_of_other_languages_and_signs_in_values():
    text = lambda page: [b.text for b in extract.leaf_blocks(page)]
    assert text('<p>a</p><svg class="x" href="#i" /><p>b</p><math/><p>c</p><svg><text>no</text></svg>d') == ["a", "b", "c", "d"]
    assert text("<svg/><p>a</p><svg width/>b") == ["a", "b"] and text("<svg a=b/>no</svg><p>c") == ["c"]
    assert text("<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><mspace/><annotation>x=2</annotation></math> is.</p>") == ["So x=2 is."]
    assert text("<p>So <math><mi>x</mi><mspace/></math> is.</p>") == ["So x is."]
    assert text("<object data=a.swf><param name=b><p>No player.</p></object><p>c</p>") == ["No player.", "c"]
    assert text("""<p data-x="<b>" data-y='<p>c'>t<i title="a<b">u</i></p>""") == ["tu"]
    assert text('<a href="x>y <b>z</b> <a href="u">v</a>') == ["y z v"]


def test_long_and_broken_values_take_no_longer(model):
    start = time.monotonic()
    for part in ['<a x="', "<a x='<", '<a x="b" y="c" ', "<a =\"<\" x='", '="<a ']:
        extract.leaf_blocks("<i " + part * 20_000)
    assert time.monotonic() - start < 30


def test_long_and_broken_pages_take_no_longer(model):
    assert extract.article_text("<" * 200_000, model) is not None
    assert len(extract.leaf_blocks("<a<b" * 50_000)) >= 0
    assert len(extract.leaf_blocks("<div>" * 20_000 + "x" + "<p>y" * 1000)) == 1001


def test_extraction_of_a_table(spark, model):
    page = "<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>Title here</h1><p>First, it is so. Then it is not.</p><p>Few</p></article><footer><p>© 2020 X</p></footer>"
    rows = [(1, "u", page, "old"), (2, None, None, "old"), (3, "u", "", "old"), (1, "u", page, "old")]
    got = extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), model).collect()
    want = "Title here\nFirst, it is so. Then it is not.\nFew"
    assert [tuple(r) for r in got] == [(1, "u", want, len(want)), (2, None, "", 0), (3, "u", "", 0), (1, "u", want, len(want))]
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert extract.extract_text(empty, model).count() == 0


def test_labelled_pages_are_made_again_the_same(spark):
    a, b = (extract.labelled_pages(spark, 5).collect() for _ in range(2))
    assert a == b and all(r["article"] for r in a)


def test_elements_that_are_left_open_lose_no_text():
    text = lambda page: [b.text for b in extract.leaf_blocks(page)]
    for tag in ("svg", "select", "iframe", "noscript", "template"):
        assert text(f"<p>one</p><{tag}><p>two</p><div>three</div>") == ["one", "two", "three"], tag
    assert text("<p>one</p><svg><path d=x><p>two</p><svg><g>no</g></svg>three") == ["one", "two", "three"]
    assert text("<svg><foreignObject><p>no</p></foreignObject></svg><p>one") == ["one"]
    assert text("<p>one</p><script>var x = '<p>two</p>'") == ["one"]
    assert text("<p>a<select><option>b</select>c") == ["a", "c"]


def test_nested_and_unmatched_tags_take_linear_time():
    pages = (
        lambda n: "<x>" * n + "t", lambda n: "<b>" * n + "</i>" * n + "t", lambda n: "<b><div>" * n + "</b>" * n + "t",
        lambda n: "<svg><path>" * n + "t", lambda n: "<ul><li>" + "<x>" * n + "<li>t" * n,
        lambda n: "".join(f'<div class="{chr(97 + i % 26) * (1 + i // 26)}">' for i in range(n // 8)) + "t",
    )
    for page in pages:
        taken = []
        for n in (8_000, 32_000):
            start = time.process_time()
            assert extract.leaf_blocks(page(n))[-1].text == "t"
            taken.append(time.process_time() - start)
        assert taken[1] < 9 * taken[0] + 0.2


def test_names_of_open_elements_are_shared():
    blocks = extract.leaf_blocks('<div class="a b"><p class="a">x<p class="c">y</p></div>z')
    assert [b.path for b in blocks] == [
        frozenset({"in:div", "is:a", "is:b", "in:p"}), frozenset({"in:div", "is:a", "is:b", "in:p", "is:c"}), frozenset()
    ]
    deep = extract.leaf_blocks("".join(f'<div class="n{"x" * (i % 40)}{"y" * (i // 40)}">t' for i in range(2000)))
    assert sum(len(b.around.own) for b in deep) < 2 * len(deep) + 2 and len(deep[-1].path) == 2001


def test_extraction_against_a_plain_reader(model):
    """Blocks of made pages, against the library's own HTML reader where pages are well formed."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.found, self.now, self.hidden = [], "", 0

        def flush(self):
            if self.now.split():
                self.found.append(" ".join(self.now.split()))
            self.now = ""

        def handle_starttag(self, tag, attrs):
            if tag in ("script", "style", "title"):
                self.hidden += 1
            if tag == "br":
                self.now += " "
            elif tag not in extract.INLINE:
                self.flush()

        def handle_endtag(self, tag):
            if tag in ("script", "style", "title"):
                self.hidden -= 1
            if tag not in extract.INLINE:
                self.flush()

        def handle_data(self, data):
            if not self.hidden:
                self.now += data

    compared = 0
    for seed in range(300):
        page, _ = extract.PageMaker(seed).page()
        if any(f"<{t}" in page for t in extract.RAW - {"script", "style", "title"}):
            continue
        reader = Plain()
        reader.feed(page)
        reader.close()
        reader.flush()
        assert [b.text for b in extract.leaf_blocks(page)] == reader.found, seed
        compared += 1
    assert compared > 50
