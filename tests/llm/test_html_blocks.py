from html.parser import HTMLParser

from foldstore.llm import html_blocks as H

PAGE = """<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a><li><a href="/b">About us</a></ul></nav><!-- <p>not this</p> --><div class="ad">Buy now, a long advert of many words without any links in it at all.</div>
<div id="cookie-notice">We use cookies to make this site better for you.</div><header><h2>Site name</h2></header>
<article><h1>T &amp; U</h1><p><b>One   two<br>three<p>Four &quot;five&quot; &#233; <a href=x>six</a>.</p><p></p><p>&nbsp;Seven</p><div class="share">Tweet this</div>
<table><tr><td>cell 1<td>cell 2</table></article><aside>Related things to read</aside><form><label>Name</label><input name=q></form><section class="comments"><p>First! I am a reader with a long opinion about all of this.</p></section>
<footer>&copy; site</footer></body></html>"""


def test_main_text():
    assert H.main_text(PAGE) == 'T & U\n\nOne two three\n\nFour "five" é six.\n\nSeven\n\ncell 1\n\ncell 2'


def test_pages_without_an_article_element():
    page = '<body><ul class="menu"><li><a href=x>Home</a></ul><div><h1>A title of several words</h1><p>' + "word " * 40 + "</p><p>" + "more " * 30 + "</p></div><p><a href=1>next page</a></p><div id=footer>(c) nobody</div></body>"
    assert H.main_text(page) == "A title of several words\n\n" + ("word " * 40).strip() + "\n\n" + ("more " * 30).strip()


def test_odd_pages():
    assert H.main_text(None) == "" and H.main_text("") == "" and H.main_text("<nav>x</nav>") == ""
    assert H.main_text("<article><p>a < b and <i>c</i>d</article>") == "a < b and cd"
    assert H.main_text("<ARTICLE><P CLASS='x'>Upper</P></ARTICLE>") == "Upper"
    assert H.main_text("<article><p>open") == "open"
    assert H.main_text("<article><script>never closed <p>x") == ""
    assert H.main_text("<article><p>" + "long " * 200_000) == ("long " * 200_000).strip()
    assert H.main_text("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>") == "deep"


def test_blocks_have_features():
    found = H.blocks('<p>one <a href=x>two three</a></p><nav>four</nav>')
    assert [(b.words, b.linked, b.boilerplate) for b in found] == [(3, 2, False), (1, 0, True)]
    assert H.rows(found)[0][:6] == (3, 2 / 3, 0, 0.0, 1, 0.0)


def test_tree_fits_its_table():
    assert all(H.is_main(r[:-1], H.tree()) == bool(r[-1]) for r in H.table())


def used(node):
    return set() if isinstance(node, int) else {node[0]} | used(node[2]) | used(node[3])


def test_neighbours_decide():
    assert used(H.tree()) & set(H.NEIGHBOURS)
    alone = H.grow([tuple(0 if k in H.NEIGHBOURS else v for k, v in enumerate(r)) for r in H.table()])
    paragraph = "<p>" + "word " * 40
    between_text = f"<body>{paragraph}<p>and so on{paragraph}</body>"
    between_links = f"<body>{paragraph}<p><a href=1>next page</a><p>and so on<p><a href=2>last page</a></body>"
    found = [H.blocks(page) for page in (between_text, between_links)]
    verdict = lambda tree, k, at: H.is_main(H.rows(found[k])[at], tree)
    assert verdict(H.tree(), 0, 1) and not verdict(H.tree(), 1, 2)
    blind = [tuple(0 if k in H.NEIGHBOURS else v for k, v in enumerate(H.rows(found[i])[at])) for i, at in ((0, 1), (1, 2))]
    assert H.is_main(blind[0], alone) == H.is_main(blind[1], alone)


def test_short_blocks_of_unmarked_pages_stay():
    words = lambda n: " ".join(["word"] * n)
    page = f"<body><h1>{words(3)}</h1><p>{words(40)}<p>{words(2)}<p>{words(1)}<p>{words(30)}<h2>{words(4)}</h2><p>{words(25)}</body>"
    assert H.main_text(page) == "\n\n".join(words(n) for n in (3, 40, 2, 1, 30, 4, 25))


def test_parts_of_a_line_and_contradicting_names():
    assert H.main_text('<article><p>one <span class="ad">buy <span>now</span> here</span>two <span hidden>never</span><b style="display: none">nor this</b>three <em class="x">four</em></article>') == "one two three four"
    assert H.main_text('<article><p>a<span class=ad>b<p>c</article>') == "a\n\nc"
    text = "word " * 50
    assert H.main_text(f'<article class="post header"><p>{text}</article>') == text.strip()
    assert H.main_text(f'<div class="content related-post"><p>{text}<p>{text}</div>') == "\n\n".join([text.strip()] * 2)
    assert H.main_text(f'<body><p>{text}<p>{text}<div id="feedback"><p>What a long and winding text this is<p>I liked it very much indeed</div></body>') == "\n\n".join([text.strip()] * 2)


class Simple(HTMLParser):
    """Text of article elements by another parser: no marks but elements, adverts by their class."""

    BREAKS = set("p div li ul ol h1 h2 h3 h4 h5 h6 article section table tr td th blockquote pre br".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.skip, self.out, self.part = 0, [], [], ""

    def flush(self):
        if " ".join(self.part.split()):
            self.out.append(" ".join(self.part.split()))
        self.part = ""

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside += 1
        if tag in ("script", "style", "nav", "footer") or dict(attrs).get("class") == "ad":
            self.skip.append(tag)
        self.part += "\n" if tag == "br" else ""
        if tag in self.BREAKS and tag != "br":
            self.flush()

    def handle_endtag(self, tag):
        if tag in self.BREAKS and tag != "br":
            self.flush()
        if self.skip and self.skip[-1] == tag:
            self.skip.pop()
        if tag == "article":
            self.inside -= 1

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.part += data


def test_all_pages_against_a_simple_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in H.extract(pages, ["page_id"]).collect()}
    assert len(got) == pages.count() > 100
    for r in pages.collect():
        simple = Simple()
        simple.feed(r.html or "")
        simple.close()
        simple.flush()
        assert got[r.page_id] == "\n\n".join(simple.out), r.page_id


def test_query_form(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None), (3, "u", "", "y")], "page_id long, url string, html string, text string")
    rows = H.extract(pages, ["page_id", "url", "text"]).collect()
    assert H.extract(pages, ["page_id", "text", "n_chars"] if "n_chars" in pages.columns else ["page_id", "text"]).columns == ["page_id", "text", "n_chars"]
    assert len(rows) == 4 and all(r.n_chars == len(r.text) for r in rows) and sum(r.text == "" for r in rows) == 2
    assert H.extract(pages.limit(0), ["page_id", "url"]).count() == 0
