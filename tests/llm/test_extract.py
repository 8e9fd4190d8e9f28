import html
import re

import pytest

from tablewarden.llm import extract

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def chain(spark):
    return extract.train(spark.read.parquet(f"{TABLES}/pages.parquet"))


def plain(page):
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    return "\n".join(t for t in (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)) if t)


def test_pages_give_their_articles(spark, chain):
    pages = spark.read.parquet(f"{TABLES}/../sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in extract.extract(pages, chain).collect()}
    for row in pages.collect():
        assert got[row["page_id"]]["text"] == plain(row["html"])
        assert got[row["page_id"]]["n_chars"] == len(plain(row["html"])) and got[row["page_id"]]["url"] == row["url"]


def test_held_out_layouts(chain):
    tagger, wrong, total = extract.Tagger(chain), 0, 0
    for page in extract.made_pages(100, seed=77):
        blocks = extract.blocks_of(page)
        tags = tagger.tags(blocks)
        wrong += sum(t != (extract.MARKED in b.above) for b, t in zip(blocks, tags))
        total += len(blocks)
    assert wrong / total < 0.03


def test_blocks_of_awkward_pages():
    text = lambda page: [b.text for b in extract.blocks_of(page)]
    assert text("<p>a<p>b &amp; c<br>d<li>e") == ["a", "b & c d", "e"]
    assert text('<script>var a = "<p>no</p>";</script><p title="a > b">yes</p><style>p{}</style>') == ["yes"]
    assert text("<!-- <p>no</p> --><p>x<!-- unclosed") == ["x"]
    assert text("<head><title>t</title><body><p>1 < 2 &lt; 3</p>") == ["1 < 2 < 3"]
    assert text("<p>a <b>bold</b> word</p><textarea>no</textarea><select><option>no</select>") == ["a bold word"]
    assert text("<div><b>x<p>y</b>z</div>w") == ["x", "yz", "w"]
    assert text("</p></div>loose") == ["loose"] and text("") == [] and text("<") == ["<"] and text("<p") == []
    assert text("<p class='a'b\"c>x") == ["x"]
    assert len(text("<div>" * 20_000 + "x")) == 1 and len(text("<p>y" * 20_000)) == 20_000


def test_every_row_gives_a_row(spark, chain):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article><p>One sentence here.</p></article>"), (3, "u", "<article><p>Hi there.</p></article>"), (3, "u", "<article><p>Hi there.</p></article>")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = sorted(map(tuple, extract.extract(pages, chain).collect()), key=str)
    want = [(1, "u", "", 0), (2, None, "", 0), (None, "u", "One sentence here.", 18), (3, "u", "Hi there.", 9), (3, "u", "Hi there.", 9)]
    assert got == sorted(want, key=str)
    assert extract.extract(pages.where("false"), chain).count() == 0


def test_unclosed_controls_lose_nothing():
    texts = lambda html: " ".join(b.text for b in extract.blocks_of(html)).split()
    for tag in ("button", "select", "svg", "object", "canvas"):
        assert "b" in texts(f"<article><p>a</p><{tag}>Share<p>b</p></article><p>c</p>") and "c" in texts(f"<div><{tag}>x</div><p>c</p>"), tag
        assert texts(f"<p>a</p><{tag}>no</{tag}><p>b</p>") == ["a", "b"]
    assert "b" in texts("<p>a</p><button>x<p>b</p><button>y</button><p>c</p>")


def test_late_names_of_a_class_count():
    (block,) = extract.blocks_of('<div class="a b c d e f sidebar"><p>t</p></div>')
    assert "name sidebar" in block.above


# Pages written by hand, none from the generators: the main blocks of each.
TALE = ["The river rose three feet overnight, and by morning the lower road was gone.", "Nobody in the village had seen water so high since the winter of 1962."]
FOREIGN = {
    "div only": ('<div id="masthead"><a href="/">Valley News</a></div><div id="primary"><h1>Flood in the valley</h1><p>{0}</p><p>{1}</p></div>'
                 '<div id="secondary"><ul><li><a href="/a">Weather</a></li><li><a href="/b">Sport</a></li></ul></div><div id="respond"><a href="/login">Log in to reply</a></div>', ["Flood in the valley", *TALE]),
    "bare": ("<p>{0}</p><p>{1}</p>", TALE),
    "unknown names": ('<div class="zq1"><a href="/">Home</a> <a href="/x">About</a></div><div class="kk9"><h1>Flood in the valley</h1><p>{0}</p><p>{1}</p></div><div class="pt4">&copy; 2024 Valley News | <a href="/t">Terms</a></div>',
                      ["Flood in the valley", *TALE]),
    "table": ('<table><tr><td width="150"><a href="/a">Home</a><br><a href="/b">Archive</a><br><a href="/c">Contact</a></td><td><h1>Flood in the valley</h1><p>{0}</p><p>{1}</p></td></tr></table>', ["Flood in the valley", *TALE]),
    "notice inside": ('<article><h1>Flood in the valley</h1><p>{0}</p><div class="gdpr">We use cookies to improve this site.</div><p>{1}</p></article>', ["Flood in the valley", *TALE]),
    "comments without the word": ('<article><h1>Flood in the valley</h1><p>{0}</p><p>{1}</p></article><section id="discussion"><h3>3 responses</h3><p>So sad to see this.</p></section>', ["Flood in the valley", *TALE]),
    "list": ('<main><h1>Flood in the valley</h1><p>{0}</p><ul><li>Lower road closed until Friday</li><li>School open from ten</li></ul><p>{1}</p></main><footer>Valley News</footer>',
             ["Flood in the valley", TALE[0], "Lower road closed until Friday", "School open from ten", TALE[1]]),
}


def test_foreign_layouts(chain):
    tagger, right, got, wanted, report = extract.Tagger(chain), 0, 0, 0, {}
    for name, (page, main) in FOREIGN.items():
        found = tagger.main_text(page.format(*TALE)).split("\n")
        assert found != [""], name
        right, got, wanted = right + len(set(found) & set(main)), got + len(found), wanted + len(main)
        if found != main:
            report[name] = found
    f1 = 2 * right / (got + wanted)
    print(f"block F1 {f1:.3f}", report)
    assert f1 >= 0.95


def test_unclosed_controls_take_linear_time():
    import time

    for piece in ("<object><i>x", "<svg>x", "<button>x", "<template><p>x"):
        start = time.perf_counter()
        extract.blocks_of(piece * 100_000)
        assert time.perf_counter() - start < 5, piece
