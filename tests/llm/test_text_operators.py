"""Token counts, PII, HTML text, toxicity and LM scores: brute force, exact cases, held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftgraph.llm import pii, textkit
from weftgraph.llm.html_text import html_text, main_text
from weftgraph.llm.lm_scoring import lm_score
from weftgraph.llm.shared import ship
from weftgraph.llm.token_counts import Automaton, token_counts
from weftgraph.llm.toxicity import toxicity

PIECES = [bytes([b]) for b in range(256)] + [b" a", b"ab", b"abc", b"bca", b" abca", b"cab", b"bcabc", b"\xc3\xa9"]


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def greedy(word: bytes) -> list[int]:
    rank, out, at, data = {p: i for i, p in enumerate(PIECES)}, [], 0, b" " + word
    while at < len(data):
        end = next(e for e in range(len(data), at, -1) if data[at:e] in rank)
        out.append(rank[data[at:end]])
        at = end
    return out


def split(text):
    return [w for w in re.split("[ \t-\r]+", text or "") if w]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcé", min_size=1, max_size=12), min_size=1, max_size=8))
def test_automaton_equals_greedy_matching(words):
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    w = textkit.Words(data, np.array([0, len(data)]))
    machine = Automaton(PIECES)
    want = [greedy(x.encode()) for x in words]
    ids, at = machine.pieces(data, w.start, w.end)
    assert machine.count(data, w.start, w.end).tolist() == [len(x) for x in want]
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want


def test_token_counts_of_odd_texts(spark):
    texts = ["abca  bcabc x\nabc", "", None, " \t", "a" * 300 + " é"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "ab"), (0, texts[0])], "doc_id long, text string").withColumn("n_words", F.lit(1))
    got = token_counts(docs, PIECES).collect()
    want = Counter((i, len(split(t)), sum(len(greedy(w.encode())) for w in split(t))) for i, t in [*enumerate(texts), (None, "ab"), (0, texts[0])])
    assert Counter(map(tuple, got)) == want
    with pytest.raises(ValueError):
        Automaton([b"a"])


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            total = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d)))
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(d) <= 19 and total % 10 == 0, "phone": 10 <= len(d) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{x[3]}:{x[0]}:{x[2]}" for x in sorted(out))


@settings(max_examples=150, deadline=None)
@given(st.text("a.@-+1 029(é", max_size=60))
def test_base_spans_equal_the_plain_patterns(text):
    assert ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e, _ in pii.base_spans(text)) == plain_spans(text)


def test_pii_adds_terms_that_reveal_an_entity_in_several_contexts(spark):
    rng = random.Random(2)
    filler = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    docs = [(i, f"{filler(3)} zorblax wrote from jo@x.example.com {filler(3)}") for i in range(4)]
    docs += [(10 + i, f"{filler(6)} wrote nothing") for i in range(40)] + [(60, "éé 4111 1111 1111 1111 and 10.0.0.1, +1 (555) 123-4567"), (61, None), (62, "")]
    docs += [(70 + i, "copied quuxly text from al@y.example.org here") for i in range(5)]
    got = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame(docs, "doc_id long, text string").withColumn("spans", F.lit(0))).collect()}
    for d, text in docs:
        base = plain_spans(text or "")
        assert got[d]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [s for s in got[d]["spans"].split(",") if s and not s.startswith("term")] == ([s for s in base.split(",")] if base else [])
    at = docs[0][1].index("zorblax")
    assert f"term:{at}:{at + 7}" in got[0]["spans"].split(",")
    assert got[72]["n_terms"] == 0  # copies are one context
    assert (got[60]["n_card"], got[60]["n_ip"], got[60]["n_phone"]) == (1, 1, 1)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert clean[60] == "éé [card] and [ip], [phone]" and "zorblax" not in clean[0] and clean[61] is None and clean[62] == ""


def test_pii_counts_terms_over_whole_documents(spark):
    far = "and so it went on, as it does. " * 30  # beyond 400 characters and 8 words of the mention
    docs = [(1, f"Zorblax here. {far} mail to jo@x.example.com {far} again zorblax"), (2, "the Zorblax, elsewhere"), (3, "copied quuxly al@y.example.org"), (4, "copied quuxly al@y.example.org")]
    docs += [(10 + i, f"{far} nothing {i}") for i in range(60)]
    got = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    text = docs[0][1]
    want = [f"term:{m.start()}:{m.end()}" for m in re.finditer("zorblax", text, re.I)]
    assert [s for s in got[1]["spans"].split(",") if s.startswith("term")] == want and len(want) == 2 == got[1]["n_terms"]
    # the value is in one text only, so 1 - log(2) / log(63 texts) = 0.83 of it is given away
    assert [c["action"] for c in got[1]["cuts"] if c["kind"] == "term"] == ["remove"] * 2
    assert got[2]["n_terms"] == got[3]["n_terms"] == got[4]["n_terms"] == 0


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h2>Site name</h2></header><nav><ul><li><a href="/">Home</a><li><a>News</a></ul></nav>
<div id="content"><h1>A &amp; B</h1><p>First <b>bold</b>text, with commas, and a stop. It goes on for a while, as texts do.<p>Short one.<script>var x = "</p>";</script>
<div class="cookie-notice">We use cookies, please, accept them all. Thanks.</div><p>Last paragraph, of   several words, which
end here; indeed.</p></div><div class="sidebar"><p>Other things, here. And there.</p></div><div id="comments"><p>I disagree, strongly, with all of it; more than words, can say. And on, and on.</p></div>
<form><label>Name</label></form><footer>&copy; 2020</footer></body></html>"""


def test_main_text_of_pages(spark):
    want = "A & B First boldtext, with commas, and a stop. It goes on for a while, as texts do. Short one. Last paragraph, of several words, which end here; indeed."
    assert main_text(PAGE) == want
    assert main_text(None) == main_text("") == main_text("<div><script>x</script></div>") == ""
    assert main_text("just text & more") == "just text & more"
    rows = spark.createDataFrame([(1, "u", PAGE), (None, None, None)], "page_id long, url string, html string").withColumn("text", F.lit(5))
    got = {r["page_id"]: r for r in html_text(rows).collect()}
    assert got[1]["text"] == want and got[1]["n_chars"] == len(want) and (got[None]["text"], got[None]["n_chars"]) == ("", 0)


PROSE = [f"Sentence number {i}, which is long enough to count as prose, and goes on; then it stops. Another one follows it." for i in range(6)]
BODY = "".join(f"<p>{x}</p>" for x in PROSE)


@pytest.mark.parametrize("around", ['<div class="legal-guide">%s</div>', '<div id="search-engines-explained">%s</div>', '<form action="x"><div>%s</div></form>', '<div class="ads"><article>%s</article></div>', "%s", "<table><tr><td>%s</table>", "<b><i>%s"])
def test_main_text_ignores_names_of_what_holds_the_whole_text(around):
    page = "<body><nav><ul><li><a href=x>Home page</a></ul></nav>" + around % BODY + "<footer>Copyright, all rights reserved. Contact.</footer>"
    assert main_text(page) == " ".join(PROSE)


def test_main_text_leaves_out_teasers_and_keeps_headings_and_lists():
    for teasers in ("<div><h3><a href=a>Teaser one here</a></h3></div>", "<div><ul><li><a href=a>Teaser one</a></li><li><a href=b>Second</a></li></ul></div>", '<div class="ad">Buy this, now. Really.</div>'):
        assert main_text(f"<main><h1>The title</h1>{BODY}{teasers}</main>") == main_text(f"<main>{teasers}<h1>The title</h1>{BODY}</main>") == "The title " + " ".join(PROSE)
    apart = f"<div><div><h2>Heading apart</h2></div><div>{BODY}<ul><li>one point<li>two</ul>{BODY}</div></div>"
    assert main_text(apart) == " ".join(["Heading apart", *PROSE, "one point two", *PROSE])


def test_main_text_of_random_pages_equals_the_article_they_were_made_of():
    rng = random.Random(12)
    sentence = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(4, 14))) + rng.choice(".!?")
    junk = [lambda: "<nav>" + "".join(f"<li><a href=/{i}>{sentence()[:9]}</a>" for i in range(4)) + "</nav>", lambda: f'<div class="ad">{sentence()}</div>', lambda: f"<aside><p>{sentence()}</p></aside>", lambda: f'<div id="comments"><p>{sentence()}</p><p>{sentence()}</p></div>', lambda: f"<footer>{sentence()}</footer>", lambda: f"<script>var x = '{sentence()}'</script><!-- {sentence()} -->"]
    for _ in range(200):
        blocks = [" ".join(sentence() for _ in range(rng.randrange(3, 8))) for _ in range(rng.randrange(3, 9))]
        article = "".join(f"<p>{b.replace(' ', rng.choice([' ', chr(10), '  ']), 1)}" + rng.choice(["", "</p>"]) for b in blocks)
        wrap = rng.choice(["<article>%s</article>", '<div class="story-%d"><section>%%s</section></div>' % rng.randrange(9), "<div><div><div>%s</div></div></div>"])
        page = "<html><head><title>t</title></head><body>" + "".join(rng.choice(junk)() for _ in range(rng.randrange(3))) + wrap % article + "".join(rng.choice(junk)() for _ in range(rng.randrange(3))) + "</body></html>"
        assert main_text(page) == " ".join(blocks), page


def test_main_text_takes_linear_time():
    import time

    for unit in ("<div>x", "<b>", "</x>", "<a ", '<a "x>" ', "<li>x", "<p><b>", "<b><i></b>", "<td>x<table>"):
        times = []
        for n in (12500, 50000):
            start = time.process_time()
            main_text(unit * n + "x")
            times.append(time.process_time() - start)
        assert times[1] < 0.3 + 9 * times[0], unit


def test_toxicity_separates_held_out_documents(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    docs, labels = [], []
    for i in range(700):
        bad = i % 4 == 0
        w = [word() for _ in range(40)]
        if bad:
            w[rng.randrange(40)] = rng.choice(["Idiotx!", "scumx", "moronx,"])
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs += [(9001, None), (9002, ""), (None, "scumx"), (9003, "scumx " * 5000)]
    labels += [(9001, None), (None, 1)]
    df, lab = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x")), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity(df, lab).collect()}
    truth = dict(labels)
    held = [i for i in range(700) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(700))
    pos, neg = [got[i]["score"] for i in held if truth[i]], [got[i]["score"] for i in held if not truth[i]]
    assert np.mean([[p > n for n in neg] for p in pos]) > 0.95 and got[9001]["score"] == got[9002]["score"] and all(0 <= r["score"] <= 1 for r in got.values())
    none = toxicity(df, lab.filter("1 = 0")).first()
    assert none["score"] == 0.5


def test_lm_scores(spark):
    rng = random.Random(6)
    words = ["the", "cat", "sat", "on", "a", "mat", "and", "ran"]
    docs = [(i, " ".join(rng.choice(words) if rng.random() < 0.9 else "".join(rng.choice("xyz") for _ in range(6)) for _ in range(rng.randrange(5, 60)))) for i in range(150)]
    docs += [(1000, None), (1001, ""), (1002, "The THE É"), (None, "the cat"), (1003, "q" * 400), (7, docs[7][1])]
    got = lm_score(spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit(1)), PIECES, head=4).collect()
    token = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in split(t)]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts, n = Counter(), 0
    for i, t in docs:
        if not out(i):
            counts.update(token(t))
            n += 1
    total, kinds = sum(counts.values()) + n, len(counts) + 1
    p = lambda c: math.log10((c + 0.5) / (total + 0.5 * (kinds + 1)))
    want = Counter((str(i), out(i), len(token(t)) + 1, sum(w in counts for w in token(t)) + 1, total, round(sum(p(counts[w]) for w in token(t)) + p(n), 6)) for i, t in docs)
    assert Counter((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    # a model of context beats one of single words where text repeats: held-out texts of a fixed rhyme
    rhyme = "the cat sat on a mat and the dog ran to the red house on the hill".split()
    more = [(i, " ".join(rhyme[j % len(rhyme)] for j in range(i, i + 40))) for i in range(300)]
    held = [r for r in lm_score(spark.createDataFrame(more, "doc_id long, text string"), PIECES).collect() if r["held_out"]]
    assert held and sum(r["score"] for r in held) > 0.9 * sum(r["base_score"] for r in held)


def test_lm_scores_depend_on_neither_the_head_nor_the_partitions(spark):
    docs = [(i, " ".join(f"w{(i * j) % 37}x" for j in range(1, 20 + i))) for i in range(40)] + [(99, "unseen qqq w1x"), (100, None), (None, "w1x w2x"), (7, "w1x")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in lm_score(df.coalesce(1), PIECES, shard=8, steps=30).collect())
    for parts, head in ((1, 3), (6, 1 << 20)):
        got = sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in lm_score(df.repartition(parts), PIECES, head=head, shard=8, steps=30).collect())
        assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-9)
    empty = lm_score(df.filter("1 = 0"), PIECES)
    assert empty.count() == 0 and empty.columns[-1] == "score"
    only = lm_score(df.filter("doc_id = 9"), PIECES).first()  # 9 may be the only text, held out or not
    assert only["score"] < 0 and only["n_tokens"] == 29


def test_attention_scores_are_a_distribution():
    """Words of two ids, a start and one that goes on, with its end: all of them together have probability 1."""
    from weftgraph.llm.attention import AttentionLM, Windows

    starts = np.array([True, True, True, False, False, True, False])  # 5 ends, 6 begins a text
    counts = np.array([5, 9, 3, 4, 2, 3, 0])
    seqs = [np.array([6, 0, 3, 1, 4, 3, 2, 5]), np.array([6, 5]), np.array([6] + [1, 3, 4, 2, 0] * 20 + [5])]
    off = np.concatenate(([0], np.cumsum([len(s) for s in seqs])))
    tokens = np.concatenate(seqs).astype(np.int32)
    windows = Windows(off, 4)
    at = windows.places(slice(None))
    scored = [p for row, o in zip(at, windows.owner, strict=True) for p, q in zip(row[5:], row[4:-1], strict=True) if p >= 0 and q >= 0]
    assert sorted(scored) == [i for i in range(len(tokens)) if i not in off]  # each id once, the first of a text never
    m = AttentionLM(counts, starts, None, size=4, dim=4, rows=16, own=3, clusters=1).fit(np.where(at >= 0, tokens[np.maximum(at, 0)], -1), np.arange(3), 1e-2)
    context = [6, 0, 3, 1, 4, 3]

    def after(ids):
        x = np.array(context + ids, np.int32)
        return [v.astype(float) for v in m.log10(x, np.array([0, len(x)]))]

    each, ends = after([2, 2])
    given = sum(10 ** after([t])[0][-1] for t in np.flatnonzero(starts))
    on = sum(10 ** after([t])[0][-1] for t in np.flatnonzero(~starts))
    assert given == pytest.approx(1, abs=1e-4) and on + 10 ** after([2])[1][-1] == pytest.approx(1, abs=1e-4)
    both, _ = m.log10(tokens, off)
    apart = np.concatenate([m.log10(s.astype(np.int32), np.array([0, len(s)]))[0] for s in seqs])
    assert (both == apart).all()


def test_attention_gradient_is_that_of_the_loss():
    from weftgraph.llm.attention import AttentionLM

    starts = np.array([True, True, False, False, True, False])
    m = AttentionLM(np.array([5, 9, 3, 4, 2, 0]), starts, None, size=3, dim=4, rows=16, own=2, clusters=1)
    windows = np.array([[-1, -1, -1, 5, 0, 2, 1], [5, 0, 2, 1, 3, 4, -1], [1, 2, 0, 3, 2, 1, 0]])
    grad = m._gradient(windows)

    def loss():
        # by definition: softmax attention over earlier inputs, then the class of the successor
        total, n = 0.0, 0
        for w in windows:
            x = [m.p["E"][m.row[t]].astype(float) if t >= 0 else None for t in w[:-1]]
            qkv = [None if v is None else v @ m.p["W"].astype(float) for v in x]
            for i in range(3, 6):
                if w[i] < 0 or w[i + 1] < 0:
                    continue
                js = [j for j in range(i + 1) if w[j] >= 0]
                a = np.array([qkv[i][:4] @ qkv[j][4:8] / 2 + m.p["B"][min(i - j, 5)] for j in js])
                a = np.exp(a - a.max())
                u = sum(p * qkv[j][8:] for p, j in zip(a / a.sum(), js, strict=True))
                h = x[i] + u @ m.p["O"]
                h = h + np.maximum(h @ m.p["W1"] + m.p["b1"], 0) @ m.p["W2"]
                logit = h @ m.p["C"] + m.p["bc"]
                total += np.log(np.exp(logit - logit.max()).sum()) + logit.max() - logit[m.of[w[i + 1]]]
                n += 1
        return total / n

    rng = np.random.default_rng(4)
    for name, g in grad.items():
        for at in rng.choice(m.p[name].size, min(6, m.p[name].size), replace=False):
            old = m.p[name].flat[at]
            m.p[name].flat[at] = old + 1e-2
            up = loss()
            m.p[name].flat[at] = old - 1e-2
            down = loss()
            m.p[name].flat[at] = old
            assert g.flat[at] == pytest.approx((up - down) / 2e-2, abs=3e-3), name
