"""HTML extraction, language ID, secret scans."""

import hashlib
import random
import re
import string
import time
import zlib

import pytest
from pyspark.sql import functions as F

from lithos.llm import html, langid, secrets
from lithos.llm.queries import PIECE_FILE, RANK_FILE

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="no-sidebar">
<header class="site-header">Site</header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
<aside>Side</aside><!-- x > y --><article><h1>Big &amp; <b>bo</b>ld&nbsp;title</h1><p>One
 two<br>three &#8364;&lt;p&gt;<p>Yes.<div class="ad"><p>Buy!</p></div><form><input><button>Go</button></form><p></p><p>Last <a href=x title="a>b">link</a>
<section id="comments"><p>First!</p></section></article><footer>&copy; me</footer></body></html>"""


def test_article_without_furniture():
    assert html.main_text(PAGE) == "Big & bold title\nOne two three €<p>\nYes.\nLast link"


def test_page_without_article():
    page = "<div id=menu><a href=a>Home</a> <a href=b>About</a></div><div class=post><p>" + "Long text here. " * 9 + "<p>Short.</div><div class=footer>x</div>"
    assert html.main_text(page) == ("Long text here. " * 9).strip() + "\nShort."


@pytest.mark.parametrize("page", [None, "", " ", "<", "<p", "<!-- never", "<script>x", "<nav>only a menu</nav>", "</p></div>", "&"])
def test_pages_without_text(page):
    assert html.main_text(page) in ("", "<", "&", "<p")


@pytest.mark.parametrize("mark", [
    '<div class="post-comments-list"><p>X</div>', '<ol class="commentlist"><li>X</ol>', '<div id=userComments>X</div>', "<div hidden>X</div>",
    '<p style="color:red; display: none">X</p>', '<section role="complementary">X</section>', '<div class="box share">X</div>', "<label>X</label>",
])
def test_furniture_in_an_article(mark):
    page = f'<article><div class="article-header"><h1>Title</h1></div><p class="adult content-shared">Text{mark}<p>More</article>'
    assert html.main_text(page) == "Title\nText\nMore"


def test_unclosed_furniture_ends_at_the_article():
    assert html.main_text("<nav><a>Home</a><article><p>Text</article>") == "Text"


LINE = "Some words of the story stand in this line, and some more of them. "
LAYOUTS = {
    "wrapper": (f'<div class="content-sidebar-right"><p>{LINE}<p>{LINE}</div>', [LINE, LINE]),
    "wrapper of article": (f'<div class="layout two-sidebar"><div class=sidebar>x</div><article><p>{LINE}</article></div>', [LINE]),
    "wrapper with furniture": (f'<div id=page class="two-sidebar"><nav>n</nav><p>{LINE * 3}<div class="ad">Buy</div><p>End.</div>', [LINE * 3, "End."]),
    "section named after comments": (f'<article><section class="comment-on-law"><p>{LINE}</section></article>', [LINE]),
    "readers write more than the author": (f"<article><h1>T</h1><p>{LINE}<div class=comments><p>{LINE * 30}<p>{LINE * 30}</div></article>", ["T", LINE]),
    "page in a form": (f"<form id=aspnetForm><p>{LINE * 4}<input></form>", [LINE * 4]),
    "formula": (f"<article><p>{LINE}<math><mi>x</mi></math> is it.</article>", [LINE + "x is it."]),
    "link between lines": (f"<p>{LINE}<p><a>a long title of a linked document</a><p>{LINE}", [LINE, "a long title of a linked document", LINE]),
    "link in a line": (f"<p>{LINE}<p>See <a>a long title of a linked document</a>.<p>{LINE}", [LINE, "See a long title of a linked document.", LINE]),
    "menu without a name": ("<ul>" + "<li><a>Menu entry</a>" * 5 + f"</ul><p>{LINE * 3}<p>{LINE * 3}<ul>" + "<li><a>Menu entry</a>" * 5 + "</ul><p>(c) me", [LINE * 3] * 2),
    "links end an article": (f"<article><p>{LINE}<ul>" + "<li><a>Other story</a>" * 5 + "</ul></article>", [LINE]),
    "links inside an article": (f"<article><p>{LINE}<ul>" + "<li><a>Other story</a>" * 2 + f"</ul><p>{LINE}</article>", [LINE, "Other story", "Other story", LINE]),
    "late section": (f"<p>{LINE * 3}<p>{LINE * 2}<ul>" + "<li><a>Menu entry</a>" * 5 + f"</ul><p>{LINE}", [LINE * 3, LINE * 2, LINE]),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    page, want = LAYOUTS[name]
    assert html.main_text(page) == "\n".join(x.strip() for x in want)


def test_windows_decide(monkeypatch):
    """Without the windows, or without surge and dive, the texts are others."""
    want = {name: html.main_text(page) for name, (page, _) in LAYOUTS.items()}

    def others():
        return {name for name, (page, _) in LAYOUTS.items() if html.main_text(page) != want[name]}

    with monkeypatch.context() as m:  # lines on their own
        m.setattr(html, "window_sums", lambda weights: weights)
        assert {"link between lines", "links inside an article"} <= others()
    with monkeypatch.context() as m:  # one window over all
        m.setattr(html, "WINDOW", 1000)
        assert {"late section", "menu without a name"} <= others()
    with monkeypatch.context() as m:  # no threshold
        m.setattr(html, "SURGE", 0.0)
        assert "menu without a name" in others()
    with monkeypatch.context() as m:  # names count, whatever the distribution says
        m.setattr(html, "LEFT_OVER", -1.0)
        assert {"wrapper", "section named after comments", "page in a form"} <= others()


@pytest.mark.parametrize("part", ['<a title="', '<a title=">', "<title>", "<svg>", "<", "<!-- ", "<div class=ad>x", "<div>x", "<a b='c\">", "&", "<b", "<select>y", "x<br>", "</p>", "<p class='ad'>y</p>"])
def test_time_is_linear_in_a_broken_page(part):
    page = part * (1_000_000 // len(part))
    began = time.process_time()
    html.main_text(page)
    assert time.process_time() - began < 4


def test_extract(spark):
    rows = spark.createDataFrame([(1, "u", PAGE, 1), (1, "u", PAGE, 1), (None, None, None, 2), (3, "v", "", 3)], "page_id long, url string, html string, TEXT int")
    found = html.extract(rows).collect()
    assert sorted((r.page_id is None, r.n_chars == 0) for r in found) == [(False, False), (False, False), (False, True), (True, True)]
    assert all(r.n_chars == len(r.text) for r in found)
    assert html.extract(rows.limit(0)).count() == 0


def _segmentations(word, chance):
    """The sum over all segmentations by brute force."""
    if not word:
        return 1.0
    return sum(chance.get(word[:n], 0.0) * _segmentations(word[n:], chance) for n in range(1, len(word) + 1))


def test_forward_sums_all_segmentations():
    import numpy as np

    pieces = ("▁", "a", "b", "ab", "▁a", "ba", "aba", "▁ab", "c")
    finder = langid.Pieces(pieces)
    chance = np.random.default_rng(1).random((len(pieces) + 1, 2))
    words = ["a", "abab", "abcab", "b" * 40, "zab"]
    logs = finder.lattice(words).forward(chance)[2]
    for k in range(2):
        table = dict(zip(pieces, chance[:, k], strict=False)) | {"z": chance[-1, k]}
        for i, w in enumerate(words):
            if len(w) < 20:
                assert abs(np.exp(logs[i, k]) - _segmentations("▁" + w, table)) < 1e-9
    # a long word is rescaled on its way: b^40 by the linear recursion
    rec = [1.0, chance[0, 0]]
    total = rec[1]
    for _ in range(40):
        total *= chance[2, 0]
    assert abs(logs[3, 0] - np.log(total)) < 1e-6


def test_expected_counts_of_words_of_any_length():
    """EM's expected counts are the weighted mean over all segmentations; long words need rescaling on both ways."""
    import numpy as np

    pieces = ("▁", "a", "b", "ab", "▁a", "ba")
    finder = langid.Pieces(pieces)
    chance = np.random.default_rng(2).random((len(pieces) + 1, 2)) * 1e-3
    number = {p: i for i, p in enumerate(pieces)}
    words = ["abba", "ab" * 9, "ba" * 300, "c", "a" * 1000]
    weight = np.random.default_rng(3).random((len(words), 2))
    got = finder.lattice(words).expected(chance, weight)
    want = np.zeros_like(chance)
    for k in range(2):
        for w, word in enumerate(words):
            text = "▁" + word
            n = len(text)
            edges = [(i, j, number.get(text[i:j], len(pieces))) for i in range(n) for j in (i + 1, i + 2) if j <= n and (text[i:j] in number or j == i + 1)]
            log = np.log(chance[:, k])
            up, down = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
            up[0] = down[n] = 0
            for i, j, p in edges:
                up[j] = np.logaddexp(up[j], up[i] + log[p])
            for i, j, p in reversed(edges):
                down[i] = np.logaddexp(down[i], down[j] + log[p])
            for i, j, p in edges:
                want[p, k] += weight[w, k] * np.exp(up[i] + log[p] + down[j] - up[n])
    assert np.allclose(got, want, rtol=1e-6)


@pytest.mark.parametrize("text", ["½ ²", "①② Ⅷ", "12 ٣٤", "́", "__ -- 3.5", "🙂"])
def test_text_without_letters(text):
    assert langid.words_of(text) == []


def test_words_keep_their_marks():
    assert langid.words_of("हिन्दी में, naïve naïve x²y 漢字_か") == ["हिन्दी", "में", "naïve", "naïve", "x", "y", "漢字", "か"]
    assert langid.words_of("Über_alles 3mal, naïve漢字") == ["über", "alles", "mal", "naïve漢字"]


def test_both_ways_to_find_words_agree():
    text = " ".join(chr(c) + "a" for c in range(0x3000) if not langid._ODD.match(chr(c).lower()))
    assert langid.words_of(text) == langid._WORDS.findall(text.lower())


def test_language_id_held_out_accuracy(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(table, PIECE_FILE, docs_per_lang=60)
    found = langid.predict(table, model).join(table.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(found) > 200
    assert sum(r.lang_pred == r.lang for r in found) / len(found) > 0.98
    assert all(0 <= r.score <= 1 for r in found)


def test_language_id_edges(spark, odd, empty):
    model = langid.train(odd, PIECE_FILE)
    found = langid.predict(odd, model).collect()
    assert len(found) == odd.count()
    assert {r.lang_pred for r in found if r.doc_id in (0, 1, 2, 3)} == {"und"}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    assert langid.keep_known(odd, model).columns == odd.columns
    nothing = langid.train(empty, PIECE_FILE)
    assert {r.lang_pred for r in langid.predict(odd, nothing).collect()} == {"und"}
    assert langid.keep_known(empty, model).count() == 0


@pytest.fixture(scope="module")
def forest(spark):
    return secrets.train(secrets.labelled_findings(spark, RANK_FILE, 1500), RANK_FILE)


def _features(rows, forest):
    each = F.explode(F.expr(secrets._found("path", forest.dictionary, "named_struct('v', v, 'f', f, 'score', " + forest.votes + ")", "null")))
    return rows.select("*", each.alias("x"))


def test_forest_on_held_out_findings(spark, forest):
    rows = secrets.labelled_findings(spark, RANK_FILE, 2400).offset(1500)
    votes = _features(rows, forest).groupBy("text", "label").agg(F.max(F.col("x.score") >= 0.5).alias("hit")).collect()
    assert sum(bool(r.label) == r.hit for r in votes) / len(votes) > 0.95


def test_printed_trees_vote_as_the_forest_does(spark, forest):
    from pyspark.ml.feature import VectorAssembler

    rows = _features(secrets.labelled_findings(spark, RANK_FILE, 600), forest).select("label", "x.f.*").cache()
    model = secrets.fit(rows)
    votes, n = secrets._conditions(model.toDebugString)
    data = VectorAssembler(inputCols=list(secrets.FEATURES), outputCol="features").transform(rows)
    printed = data.select("features", F.expr(votes.replace("f.", "")).alias("votes"))
    assert n == secrets.TREES
    for r in printed.limit(200).collect():
        assert r.votes == sum(t.predict(r.features) > 0.5 for t in model.trees)


def test_features_by_hand(spark, forest):
    words = set(forest.dictionary.words)
    texts = {1: "key: secret = 'Abc123--xyWORDSword'", 2: "commit 04dbebab91ab85687d33eeaaf9ac699e1188f962 x", 3: "from tests/thingWithWords/abc123def456ghi7 on"}
    rows = spark.createDataFrame([(k, t, "tests/a") for k, t in texts.items()], "doc_id long, text string, path string")
    for r in _features(rows, forest).collect():
        v, f = r.x.v.value, r.x.f
        kinds = re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "0", re.sub("[^A-Za-z0-9]", "_", v))))
        kinds = re.sub("[^_aA0]", "?", kinds)
        parts = [w.lower() for w in re.findall("[A-Z]?[a-z]{3,}|[A-Z]{4,}", v)]
        assert v in texts[r.doc_id] and f.length == len(v)
        assert f.transitions == pytest.approx(sum(a != b for a, b in zip(kinds, kinds[1:])) / len(v))
        assert f.digits == pytest.approx(sum(c in "0123456789" for c in v) / len(v))
        assert f.dictionary == pytest.approx(sum(len(w) for w in parts if w in words) / len(v))
        assert f.keyed == (r.doc_id == 1) and f.test_path == 1 and f.hash_near == (r.doc_id == 2)
        assert f.longest_word == pytest.approx(max(map(len, re.split("[^A-Za-z]+", v))) / len(v))


HEX = "04dbebab91ab85687d33eeaaf9ac699e1188f962"


def test_scan_and_redact(spark, docs, forest):
    text = f'Say ñ token = "{HEX}" now, then token = "{HEX}".\nEnd'
    rows = docs([(1, text, "en", "src1"), (2, "plain words only", "en", "src2"), (3, None), (4, ""), (5, f"commit {HEX} merged"), (6, "x" * 30000)])
    found = [r for r in secrets.scan(rows, RANK_FILE, model=forest).collect() if r.is_secret]
    assert sorted((r.doc_id, r.start, r.length) for r in found) == [(1, text.index(HEX), 40), (1, text.rindex(HEX), 40)]
    clean = {r.doc_id: r for r in secrets.redact(rows, RANK_FILE, model=forest).collect()}
    assert clean[1].text == text.replace(HEX, secrets.MASK) and clean[1].n_chars == len(clean[1].text)
    assert (clean[2].text, clean[3].text, clean[4].text) == ("plain words only", None, "")
    assert clean[5].text == f"commit {HEX} merged"


@pytest.mark.parametrize("size", [5_000, 20_000, 1_000_000])
def test_secrets_are_masked_whole(docs, forest, size):
    rng = random.Random(size)
    letters = string.ascii_letters + string.digits
    value = "".join(rng.choices(letters, k=size))
    lines = "\n".join(value[i : i + 64] for i in range(0, size, 64))
    block = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n\n{lines}\n-----END RSA PRIVATE KEY-----"
    texts = [f'say api_key = "{value}" here', f"the {block} here", f"open {block[:-33]} here it ends", block.replace("\n", "\\n"), f"word {value}9 word"]
    rows = docs([(i, t, "en", "src1") for i, t in enumerate(texts)])
    clean = {r.doc_id: r for r in secrets.redact(rows, RANK_FILE, model=forest).collect()}
    assert [clean[i].text for i in range(4)] == ['say api_key = "[SECRET]" here', "the [SECRET] here", "open [SECRET] here it ends", "[SECRET]"]
    assert len(clean[4].text) in (len(texts[4]), len("word [SECRET] word"))  # a bare run goes whole or stays whole
    found = secrets.scan(rows, RANK_FILE, model=forest).collect()
    assert {r.value_sha256 for r in found} == {hashlib.sha256(texts[r.doc_id][r.start : r.start + r.length].encode()).hexdigest() for r in found}


def test_starts_of_many_findings(docs, forest):
    rng = random.Random(3)
    text = " ".join(f'é token="{rng.randbytes(rng.randint(8, 20)).hex()}"' for _ in range(700))
    found = secrets.scan(docs([(1, text)]), RANK_FILE, model=forest).collect()
    want = [(m.start(1), len(m[1]), hashlib.sha256(m[1].encode()).hexdigest()) for m in re.finditer('"([0-9a-f]+)"', text)]
    assert sorted((r.start, r.length, r.value_sha256) for r in found) == want


@pytest.mark.parametrize("text", ["eyJ" * 300_000, "secret=" * 100_000, "-----BEGIN PRIVATE KEY-----" * 30_000, "a-" * 400_000, "\\n" * 300_000])
def test_scan_time_grows_with_the_text(docs, forest, text):
    began = time.time()
    assert secrets.redact(docs([(1, text)]), RANK_FILE, model=forest).count() == 1
    assert secrets.scan(docs([(1, text)]), RANK_FILE, model=forest).count() < 200_000
    assert time.time() - began < 60


def test_secret_edges(odd, empty, forest):
    assert secrets.redact(odd, RANK_FILE, model=forest).columns == odd.columns
    assert secrets.redact(odd, RANK_FILE, model=forest).count() == odd.count()
    assert secrets.scan(empty, RANK_FILE, model=forest).count() == 0
    plan = secrets.scan(odd, RANK_FILE, model=forest)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
