import random

import pytest

from lodestack.llm import html_main as hm
from lodestack.llm import license_scan as ls
from lodestack.llm import token_count as tc
from lodestack.llm.html_pages import MARK, labelled_pages


def test_license_contract(docs_of, odd):
    docs = [*odd, (20, "Released under the MIT License. x MIT-license"), (21, "a GNU General Public License"), (22, ls.TEMPLATES["mit"].upper()), (23, "padding " * 500 + ls.TEMPLATES["bsd"] + " tail" * 300), (24, "mit licenses")]
    rows = {}
    for r in ls.digest(docs_of(docs)).collect():
        rows.setdefault(r.doc_id, []).append(r)
    r = rows[20][0]
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.score) == (8, 2, 3, 6, "mit", 1.0)
    assert rows[21][0].base_labels == "gpl" and rows[24][0].n_base == 0 and rows[24][0].first_word is None
    assert rows[22][0].labels == "mit" and rows[22][0].base_labels == "" and rows[22][0].score >= 0.8
    assert "bsd" in rows[23][0].labels
    assert all(x.labels == "" and x.score == 0.0 for i in (None, 1, 2, 3, 6) for x in rows[i])
    assert ls.digest(docs_of([])).count() == 0


def test_filters_lose_no_block():
    r = random.Random(1)
    text = ls.TEMPLATES["gpl"]
    t = ls.Template("gpl", text, {w: r.randrange(100) for w in ls.alnum_words(text.encode())}, 80)
    for _ in range(200):
        w = ls.alnum_words(text.encode())
        keep = [x for x in w if r.random() < r.choice([0.75, 0.9, 1.0])]
        words = [f"f{r.randrange(50)}".encode() for _ in range(r.randrange(40))] + keep + [f"f{r.randrange(50)}".encode() for _ in range(r.randrange(40))]
        want = [(s, min(s + t.width, len(words))) for s in range(0, len(words), t.step) if len(set(words[s : s + t.width]) & set(t.tokens)) >= t.need]
        assert [(a, b) for a, b, _ in t.blocks(words, set(words))] == want


def test_token_counts_equal_the_library(docs_of, odd):
    tokenizers = pytest.importorskip("tokenizers")
    pieces = tc.load()
    mine = tc.Unigram(pieces)
    theirs = tokenizers.Tokenizer(tokenizers.models.Unigram([("<unk>", 0.0), *pieces, *[(f"<0x{i:02X}>", -99999.0) for i in range(256)]], 0, True))
    r = random.Random(2)
    cases = ["", " ", "  a  b ", "\n\nx", "日本語 ½ 🎉🎉 a", "the quick brown fox", *["".join(r.choice("ab ▁thé日🎉\n") for _ in range(40)) for _ in range(200)]]
    for s in cases:
        assert mine.count(s) == (len(theirs.encode("▁" + s.replace(" ", "▁")).tokens) if s else 0), s
    assert mine.by_word
    got = [(x.doc_id, x.n_tokens) for x in tc.digest(docs_of(odd)).collect()]
    assert sorted(got, key=str) == sorted([(i, mine.count(t)) for i, t in odd], key=str)
    assert tc.digest(docs_of([])).count() == 0


def test_vocabulary_that_crosses_words():
    u = tc.Unigram([("▁a", -1.0), ("▁b", -1.0), ("a▁b", -0.5), ("▁", -1.0), ("a", -3.0), ("b", -3.0)])
    assert not u.by_word and u.count("a b") == 2


def test_main_text_on_held_out_pages():
    model = hm.trained()
    wrong = total = 0
    for html in labelled_pages(80, 4242):
        nodes = hm.parse(html)
        want = [MARK in "".join(n.text) for n in nodes]
        for n in nodes:
            n.text = ["".join(n.text).replace(MARK, "")]
        for n, w, p in zip(nodes, want, model.marginals(nodes), strict=True):
            if n.leaf:
                total += 1
                wrong += (p[hm.CONTENT] > 0.5) != w
    assert wrong < 0.06 * total


def test_marginals_are_exact():
    import itertools

    import numpy as np

    model = hm.trained(100)
    nodes = hm.parse("<div class=ad>buy</div><p>Some text here.</p><ul><li><a>x</a></ul>")
    kinds = [hm.tag_class(n.tag) for n in nodes]
    p = np.zeros((len(nodes), 3))
    for states in itertools.product(range(3), repeat=len(nodes)):
        w = 1.0
        for i, n in enumerate(nodes[1:], 1):
            w *= model.edge.get(kinds[i], model.edge["#other"])[states[n.parent], states[i]] * model.potential(n, kinds[n.parent])[states[i]]
        for i, s in enumerate(states):
            p[i, s] += w
    assert np.allclose(p / p.sum(1, keepdims=True), model.marginals(nodes), atol=1e-6)


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><script>var t="</p>";</script></head><body><div class="cookie-banner"><p>We use cookies on this site, to serve you better.</p><button>OK</button></div>
<header><a href=/>Site</a></header><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav><article><h1>T &amp; t</h1><p>First <b>bold&nbsp;text</b>
and   more words of it.<p>Second &lt;paragraph&gt; of the story, with a <a href=x>link</a> in it.<br>Still second.</article>
<section id="comments"><div class="comment"><p>I like this story a lot, thank you.</p></div></section><aside class=sidebar><h3>More</h3><a href=/c>C</a></aside><footer>&copy; 2020 Site</footer></body></html>"""


def test_pages(spark):
    rows = [(1, "u", PAGE), (2, "u", None), (3, "u", ""), (4, None, "<"), (None, "u", "<div>" * 3000 + "<p>Deep text stands here, it is long enough.</p>"), (5, "u", "plain words only")]
    got = {r.page_id: r for r in hm.digest(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", __import__("pyspark").sql.functions.lit("clash"))).collect()}
    assert got[1].text == "T & t\nFirst bold text and more words of it.\nSecond <paragraph> of the story, with a link in it. Still second."
    assert got[1].n_chars == len(got[1].text) and got[2].text == got[3].text == "" and got[2].n_chars == 0
    assert hm.digest(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
