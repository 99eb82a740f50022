"""Token files, HTML, quality, licenses, toxicity and piece lattices against brute force, libraries and round trips."""

import math
import random
import re
import time
import zlib
from collections import Counter
from html.parser import HTMLParser

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from kindred.llm import html, licenses, pieces, quality, tokens, toxicity
from kindred.llm.common import byte_slices

from .conftest import prose

ODD = ["", " ", " a", "a  b", "a \nb\n\nc", "x\ty z", "it's 12 a", "é b,,. c!d", "a\x00b c", "we 'll  go", "日本 語🙂 ok", "a\x1cb", "▁ literal ▁▁ mark", "<s> <0x41>"]


# ---- token files


def encoded(e, texts):
    ids, ends = e.encode(pa.array(texts, pa.string()))
    return [x.tolist() for x in np.split(ids, ends[:-1])] if texts else []


def test_encoder_equals_the_library():
    e = tokens.Encoder(tokens.default_tokenizer())
    r = random.Random(3)
    parts = ["a", " ", "  ", "\n", "\t", "\u00a0", "\u2028", "\u3000", "\x1c", "\x85", "'s", "'", "x", "12", ",", ".", "!'", "é", "…", "日", "<|endoftext|>", "<|", "\r\n", "THE"]
    texts = [*ODD, *("".join(r.choice(parts) for _ in range(r.randrange(1, 12))) for _ in range(3000)), *(prose(i, 80) for i in range(5)), "x" * 5000, None]
    want = [x.ids for x in e.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert encoded(e, texts) == want and encoded(e, texts[::-1]) == want[::-1]
    assert e.encode(pa.array(texts).slice(5, 20))[0].tolist() == [i for ids in want[5:25] for i in ids]
    assert encoded(e, [None, ""]) == [[], []] and max(map(len, e.known)) <= tokens.LONG


def test_a_small_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", 60)
    e = tokens.Encoder(tokens.default_tokenizer())
    texts = [prose(i, 30) for i in range(40)]
    want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    got = [encoded(e, texts[i : i + 3]) for i in range(0, 40, 3)]
    assert [x for part in got for x in part] == want and len(e.known) < 300 and (e.uses > 1).any()


def test_pieces_of_many_texts_are_looked_up_at_once_and_learnt_once(monkeypatch):
    e = tokens.Encoder(tokens.default_tokenizer())
    r = random.Random(11)
    words = ["".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(30_000)]
    texts = [" ".join(r.choices(words, k=40_000)) for _ in range(64)]  # 20 MB
    looked, learnt = [], []
    numbers, encoded_of = e.numbers, e._encoded
    monkeypatch.setattr(e, "numbers", lambda pieces: looked.append(len(pieces)) or numbers(pieces))
    monkeypatch.setattr(e, "_encoded", lambda runs: learnt.append(sum(map(len, runs))) or encoded_of(runs))
    got = [e.encode(rows) for _, rows in byte_slices(pa.array(texts), tokens.STEP)]
    assert sum(looked) < 1.2 * len(words) * 2 and sum(learnt) < 20 * len(words)
    ids, ends = got[0]
    assert ids[: ends[0]].tolist() == e.tokenizer.encode(texts[0], add_special_tokens=False).ids and ids[ends[-2] : ends[-1]].tolist() == e.tokenizer.encode(texts[-1], add_special_tokens=False).ids


@pytest.mark.parametrize("longest", [4, 7, 20])
def test_codes_are_canonical_and_round_trip(longest):
    r = random.Random(1)
    count = {i * 3: max(1, 3 ** (10 - i)) for i in range(11)}
    lengths = tokens.code_lengths(count, longest)
    assert lengths.max() <= longest and sum(2.0 ** -int(x) for x in lengths[lengths > 0]) == 1
    if longest == 20:  # unlimited: the cost of plain Huffman codes
        heap, cost = sorted(count.values()), 0
        while len(heap) > 1:
            cost += heap[0] + heap[1]
            heap = sorted([heap[0] + heap[1], *heap[2:]])
        assert sum(count[i] * int(lengths[i]) for i in count) == cost
    book = tokens.Codebook.of(lengths)
    ids = [np.array(r.choices(list(count), list(count.values()), k=k), np.uint32) for k in (1, 127, 128, 129, 5000)]
    blocks = [tokens.pack(x, book, 128) for x in ids]
    assert all((a == b).all() for a, b in zip(tokens.unpack(blocks, book, book.table()), ids, strict=True))
    assert tokens.code_lengths({5: 9}, 4)[5] == 1
    with pytest.raises(ValueError):
        tokens.unpack(blocks, tokens.Codebook.of(tokens.code_lengths({1: 1, 2: 1}, 4)), book.table())


def test_token_files(spark, tmp_path, odd_docs):
    lib = tokens.Encoder(tokens.default_tokenizer()).tokenizer
    docs = {i: t for i, t in enumerate([*ODD, prose(9, 3000)])}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    tokens.write(df, str(tmp_path / "x"), s=tokens.Settings(block=50))
    start, want = 0, []
    for i in sorted(docs):
        ids = [*lib.encode(docs[i], add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), ids))
        start += len(ids)
    assert sorted(map(tuple, tokens.read(spark, str(tmp_path / "x")).collect())) == want
    odd = tokens.op2_token_ids(odd_docs).collect()
    assert len(odd) == 10 and {r.n_tokens for r in odd if r.doc_id in (2, 3)} == {1} and sum(r.doc_id == 6 for r in odd) == 2
    assert tokens.op2_token_ids(odd_docs.limit(0)).count() == 0


# ---- HTML


PAGE = "<html><head><title>t</title></head><body><header>Site</header><nav><ul><li>m{i}</li></ul></nav><div class='cookie-notice'>c</div>{body}<aside>side</aside><section id='comments'><p>nice {i}</p></section><footer>f{i}</footer>"


def test_articles_of_several_shapes():
    bodies = ["<article><h1>T</h1><p>One &amp; <b>two</b><p>Three<script>x</script><ul><li>a<li>b</ul></article>", "<article><h1>U</h1><p>Only</p><form>no</form></article>", "<div class='content'><h2>V</h2><p>x&nbsp;y</p><div class='share'>s</div></div>"]
    want = ["T\nOne & two\nThree\na\nb", "U\nOnly", "V\nx y"]
    for group in (bodies[:2], bodies[2:]):
        pages = [html.parse(PAGE.format(i=k, body=b)) for k, b in enumerate(group)]
        wrapper = None
        for p in pages:
            wrapper = html.expression(p) if wrapper is None else html.merge(wrapper, html.expression(p))
        html.decide(wrapper)
        assert [html.extract(p, wrapper) for p in pages] == [want[bodies.index(b)] for b in group]


def extracted(bodies):
    """Texts of pages of one host."""
    pages = [html.parse(b) for b in bodies]
    wrapper = html.expression(pages[0])
    for p in pages[1:]:
        wrapper = html.merge(wrapper, html.expression(p))
    html.decide(wrapper)
    return [html.extract(p, wrapper) for p in pages]


def test_a_host_of_mixed_templates():
    shapes = ["<article><h1>A{0}</h1><p>one {0}</p></article>", "<main><h1>M{0}</h1><p>two {0}</p></main>", "<div class='content'><h1>C{0}</h1><p>three {0}</p></div>", "<h1>P{0}</h1><p>four {0}</p>", "<article> </article><main><p>five {0}</p></main>"]
    want = ["A{0}\none {0}", "M{0}\ntwo {0}", "C{0}\nthree {0}", "P{0}\nfour {0}", "five {0}"]
    bodies = [PAGE.format(i=i, body=x.format(i)) for i in range(3) for x in shapes]
    assert extracted(bodies) == [x.format(i) for i in range(3) for x in want]


def test_a_host_of_copies():
    copy = PAGE.format(i=0, body="<h1>T</h1><p>one</p><div>two<p>three</p></div>")
    assert extracted([copy] * 4) == ["T\none\ntwo\nthree"] * 4
    varied = [PAGE.format(i=i, body=f"<h1>Site name</h1><div>text of its own {i}</div>") for i in range(4)]
    assert extracted(varied) == [f"text of its own {i}" for i in range(4)]


@pytest.mark.parametrize(
    "page",
    [
        "<html class='no-js menu'><body class='home has-sidebar'><nav>n</nav><article><p>text {i}</p></article></body>",
        "<body class='single single-post has-sidebar tag-news'><nav>n</nav><div class='content'><p>text {i}</p></div></body>",
        "<body class='has-sidebar'><p>text {i}</p></body>",
        "<body><article class='post hentry tag-news'><p>text {i}</p><div class='share'>s</div><article class='comment'>c</article></article><aside>a</aside></body>",
        "<body><div class='post hentry tag-news'><p>text {i}</p></div></body>",
        "<body><article class='related-story'><p>text {i}</p></article></body>",
        "<body><main class='content-with-sidebar menu'><p>text {i}</p></main></body>",
        "<body><div class='content with-sidebar'><p>text {i}</p></div><div class='sidebar content'>s</div></body>",
        "<body><div class='sidebar-layout'><article><p>text {i}</p></article><aside>a</aside></div><p>x</p></body>",
        "<body><main><p>text {i}</p></main><article class='related-card'>r</article></body>",
    ],
)
def test_names_of_pages_and_articles_rule_nothing_out(page):
    assert extracted([page.format(i=i) for i in range(4)]) == [f"text {i}" for i in range(4)]


def test_menus_and_comments_stay_out():
    page = "<body><div id='comments'><article class='comment'>long comment {i}, longer than the text</article></div><div class='tag-cloud'>t{i}</div><p>text {i}</p></body>"
    assert extracted([page.format(i=i) for i in range(4)]) == [f"text {i}" for i in range(4)]


def test_the_host_outweighs_tags_and_names():
    """Chrome that no tag or name gives away: teasers in article elements, a slogan that all pages share. One page alone can't tell; its host does."""
    page = "<body><div class='x1'>Slogan of the site, which is long enough to be a text</div><article><a href='/t{i}'>teaser {i} with some words of its own</a> on</article><div class='x7'><h1>Title {i}</h1><p>{body}</p></div></body>"
    bodies = [" ".join(f"word{(i + 1) * k}" for k in range(60)) for i in range(4)]
    pages = [page.format(i=i, body=b) for i, b in enumerate(bodies)]
    assert extracted(pages) == [f"Title {i}\n{b}" for i, b in enumerate(bodies)]
    assert "Slogan" in extracted(pages[:1])[0]


def test_groups_and_alignment():
    assert html.grouped(["h", "p", "p", "h", "p", "t"]) == ([0, 1, 1, 2, 3, 4], [False] * 5)
    assert html.grouped(["x", "h", "p", "h", "p", "h", "p", "t"]) == ([0, 1, 2, 1, 2, 1, 2, 3], [False, True, True, False])
    r = random.Random(10)
    for _ in range(200):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(12))] for _ in range(2))
        pairs = html.align(a, b)
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        both = [p for p in pairs if min(p) >= 0]
        assert [i for i, _ in pairs if i >= 0] == list(range(len(a))) and [j for _, j in pairs if j >= 0] == list(range(len(b)))
        assert all(a[i] == b[j] for i, j in both) and len(both) == best[-1][-1]


def test_deep_and_long_pages():
    began = time.time()
    deep = ["<body><nav>n</nav><article>" + "<div>" * 50_000 + f"<p>deep {i}</p>" + "</div>" * 50_000 + f"<p>after {i}</p></article>" for i in range(2)]
    assert extracted(deep) == [f"deep {i}\nafter {i}" for i in range(2)]
    long = ["<article>" + "".join(f"<h2>h{i} {k}</h2><p>p{i} {k}</p>" + "<ul><li>x</ul>" * (k % 7 == i) for k in range(10_000)) + "</article>" for i in range(2)]
    for i, text in enumerate(extracted(long)):
        assert text == "\n".join(x for k in range(10_000) for x in (f"h{i} {k}", f"p{i} {k}", *["x"] * (k % 7 == i)))
    assert time.time() - began < 60


class PlainExtractor(HTMLParser):
    """Blocks of the only article element, by the library's tokens; for pages of that shape."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks, self.now = False, [], []
        self.feed(page)
        self.end()

    def end(self):
        if block := " ".join("".join(self.now).split()):
            self.blocks.append(block)
        self.now = []

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag == "br":
            self.now.append("\n")
        elif tag not in ("b", "i", "a", "em", "strong", "span"):
            self.end()

    def handle_endtag(self, tag):
        if tag not in ("b", "i", "a", "em", "strong", "span"):
            self.end()
        self.inside &= tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.now.append(data)


def test_pages_of_a_table_equal_a_plain_extractor(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    bodies = {r.page_id: r.html for r in pages.collect()}
    got = {r.page_id: r.text for r in html.op3_html(pages).collect()}
    plain = {i: t for i, t in bodies.items() if t and t.count("<article") == 1 and not re.search("<(table|form|aside|section|figure|script)", t[t.index("<article") : t.index("</article")])}
    assert len(plain) > 0.5 * len(bodies) and {i: got[i] for i in plain} == {i: "\n".join(PlainExtractor(t).blocks) for i, t in plain.items()}


def test_wrappers_don_t_depend_on_partitions(spark):
    rows = [(i, f"http://h{i % 3}.org/p{i}", PAGE.format(i=i, body=f"<article><h1>T{i}</h1>" + "<p>x</p>" * (i % 4) + "<table><tr><td>a<td>b</table>" * (i % 2) + "</article>")) for i in range(24)]
    rows += [(100, None, None), (101, "no host", ""), (102, "http://h0.org/", "<<<p>broken <article"), (103, "http://h9.org", "<p>" * 3000 + "deep")]
    want = None
    for n in (1, 7):
        got = sorted(map(tuple, html.op3_html(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(n)).collect()))
        assert len(got) == 28 and (want is None or got == want)
        want = got
    assert {r[0]: r[2] for r in want}[3] == "T3\nx\nx\nx\na b" and {r[0]: r[2] for r in want}[100] == ""


# ---- quality


def test_base_counts_equal_brute_force():
    r = random.Random(4)
    for _ in range(60):
        text = "".join(r.choice(["a", "b c ", "\n", " ", "a b c\n", "#é|", "\t", "\x85"]) for _ in range(r.randrange(0, 60)))
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        marked = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
        lines = text.split("\n")
        dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
        assert quality.base_counts(text) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked))


def test_viterbi_equals_all_paths_and_fit_separates():
    r = np.random.default_rng(1)
    m = quality.Crf(r.normal(size=(quality.N_FEATURES, 2)), r.normal(size=(2, 2)), r.normal(size=2))
    for n in range(1, 8):
        x = r.integers(0, 2, (n, quality.N_FEATURES))
        e = x @ m.emit
        cost = lambda p: m.first[p[0]] + sum(e[i, s] for i, s in enumerate(p)) + sum(m.step[a, b] for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        best = max(([k >> i & 1 for i in range(n)] for k in range(1 << n)), key=cost)
        assert cost(quality.viterbi(m, x).tolist()) == pytest.approx(cost(best))
    good, bad = (quality.line_features([t] * 3)[0] for t in ("A plain line of words, as it should be.", "MENU | HOME | MENU | HOME | MENU"))
    model = quality.fit([(good, np.ones(3, int)), (bad, np.zeros(3, int))] * 5, quality.Settings(steps=40))
    assert quality.viterbi(model, good).tolist() == [1, 1, 1] and quality.viterbi(model, bad).tolist() == [0, 0, 0]


@pytest.mark.parametrize("size", [199, 200, 201, 1400, 20_003])
def test_upper_case_letters_are_counted_in_the_whole_line(size):
    r = random.Random(size)
    lines = ["".join(("A" if k % 7 == shift else "b") for k in range(size)) for shift in range(7)]  # every 7th character alone says all or none
    lines += ["".join(r.choice("aB éÉßЖжǅ中\ud800") for _ in range(size))]
    at = list(quality.EDGES).index("upper-case letters a letter")
    edges, first = quality.EDGES["upper-case letters a letter"], quality._OFFSETS[at]
    for line in lines:
        whole = sum(c.isupper() for c in line)
        assert quality.upper_letters(line) == whole
        got = quality.line_features([line])[0][0, first : quality._OFFSETS[at + 1]]
        assert got.tolist() == [int(k == np.searchsorted(edges, whole / size)) for k in range(len(edges) + 1)]


def test_quality_query(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (6, None, None)], "doc_id long, quality int, toxic int")
    rows = quality.op4_quality(odd_docs, labels).collect()
    assert len(rows) == 10 and {r.kept for r in rows if r.doc_id == 5} == {True} and not any(r.kept for r in rows if r.n_words < 50)
    assert quality.op4_quality(odd_docs.limit(0), labels.limit(0)).count() == 0
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = quality.op4_quality(docs, labels).join(labels, "doc_id").where(toxicity.held_out()).collect()
    assert sum(r.kept == (r.quality == 1 and not r.base_failed) for r in held) >= 0.97 * len(held)


def test_quality_labels_lines(spark):
    """Lines of one text get both labels: those that many texts share stand apart from the text's own."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.judge(docs, quality.train(docs, labels)).join(labels, "doc_id").where(toxicity.held_out()).select("text", "kd_labels", "quality", "kd_kept", "kd_failed").collect()
    assert sum(r.kd_kept == (r.quality == 1 and not r.kd_failed) for r in rows) >= 0.97 * len(rows)
    often = {x for x, n in Counter(x for r in rows for x in set(r.text.split("\n"))).items() if n >= 20}
    mixed = [r for r in rows if r.quality == 1 and 0 < sum(x in often for x in r.text.split("\n")) < r.text.count("\n") // 2]
    assert len(mixed) > 20 and sum(set(r.kd_labels) == {"0", "1"} for r in mixed) >= 0.8 * len(mixed)


def test_fit_follows_the_gradient_of_the_likelihood():
    r = np.random.default_rng(2)
    xs = [r.integers(0, 2, (n, quality.N_FEATURES)) for n in (1, 2, 4, 4)]
    ys = [r.integers(0, 2, len(x)) for x in xs]
    theta = [r.normal(size=(quality.N_FEATURES, 2)), r.normal(size=(2, 2)), r.normal(size=2)]

    def plain(theta):
        emit, step, first = theta
        cost = lambda x, p: first[p[0]] + sum(x[i] @ emit[:, s] for i, s in enumerate(p)) + sum(step[a, b] for a, b in zip(p, p[1:], strict=False))
        every = lambda n: ([k >> i & 1 for i in range(n)] for k in range(1 << n))
        return sum(cost(x, y.tolist()) - np.log(sum(np.exp(cost(x, p)) for p in every(len(y)))) for x, y in zip(xs, ys, strict=True))

    value, grads = quality.gradient(quality._batches(xs, 6), ys, theta)
    assert value == pytest.approx(plain(theta))
    for i, at in ((0, (3, 1)), (0, (7, 0)), (1, (0, 1)), (2, (1,))):
        moved = [t.copy() for t in theta]
        moved[i][at] += 1e-5
        assert (plain(moved) - value) / 1e-5 == pytest.approx(-grads[i][at], abs=1e-3)


def test_string_ids(spark):
    rows = [(f"d{i}", prose(i, 60) if i % 2 else "A | B | C | D !!! " * 30, "x") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, kd_score string")
    labels = spark.createDataFrame([(f"d{i}", i % 2, 1 - i % 2) for i in range(12)], "doc_id string, quality int, toxic int")
    assert quality.op4_quality(docs, labels).count() == 12 and toxicity.op6_toxicity(docs, labels).count() == 12


# ---- licenses


def test_licenses_equal_brute_force(spark):
    r, parts = random.Random(5), ["under the MIT license", "Apache License, Version 2", "CC-BY-NC", "the", "é", "12", "\n", "!!", "under the", "mit license."]
    for _ in range(80):
        text = " ".join(r.choice(parts) for _ in range(r.randrange(0, 12)))
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        want = sorted((k, i) for k, (p, _) in enumerate(licenses.BASE) for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        joined = licenses.normalised(text)
        assert joined.split() == words and sorted(licenses.detect(joined)[0]) == want
    assert len(licenses.rules()) > 250 and len({r.pattern.pattern for r in licenses.rules()}) == len(licenses.rules())


NOTICES = {
    "Licensed under the Apache License, Version 2.0.": "apache-2", "Licensed under the Apache License 2.0": "apache-2", "GPL v3 or later": "gpl-3+", "the GNU General Public License v2": "gpl-2",
    "released under the GPL v3 or later": "gpl-3+", "Distributed under the GNU GPL v3": "gpl-3", "licensed under CC BY 4.0": "cc-by-4", "licensed under the gpl version 2 or later": "gpl-2+",
    "SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2+", "SPDX-License-Identifier: Apache-2.0": "apache-2", "SPDX-License-Identifier: MIT": "mit", "SPDX-License-Identifier: MPL-2.0": "mpl-2",
    "the new BSD license and zlib license": "bsd-3-clause,zlib", "LGPL-2.1-or-later": "lgpl-2.1+", "CC-BY-NC-SA 4.0": "cc-by-nc-sa-4", "https://creativecommons.org/licenses/by-nc/4.0/": "cc-by-nc-4",
    "Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa-4", "GNU Affero General Public License v3.0": "agpl-3", "the Mozilla Public License, v. 2.0": "mpl-2",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "gpl-3+",
    "MIT or Apache-2.0": "mit,apache-2", "MIT/Apache-2.0": "mit,apache-2", "dual-licensed under MIT and Apache 2.0": "mit,apache-2", "Dual licensed under the MIT or GPLv2 licenses.": "mit,gpl-2", "License: MIT": "mit",
    "License: BSD": "bsd", "license = Unlicense": "unlicense", "This is public domain.": "public-domain", "SPDX-License-Identifier: MIT OR Apache-2.0": "mit,apache-2", "licensed under either MIT or Apache License, Version 2.0": "mit,apache-2",
    "SPDX-License-Identifier: (GPL-2.0-or-later AND BSD-3-Clause) OR MIT": "gpl-2+,bsd-3-clause,mit", "the University's MIT License office": "", "this is not the MIT license": "", "not released under the GPL v3": "",
    "no longer under the Apache License 2.0, but under the MIT license": "mit", "license key": "", "Ruby and Python 2.0": "", "mit Ruby und JSON": "", "MIT and BSD are places": "", "GPL-3.0-only OR LGPL-3.0-or-later": "gpl-3,lgpl-3+",
    "distributed subject to the terms and conditions of the MIT license": "mit", "a plain text": "", "": "",
}


@pytest.mark.parametrize("text", NOTICES)
def test_notices(text):
    found = licenses.detect(licenses.normalised(text))[1]
    assert ",".join(d.label for d in found) == NOTICES[text] and all(a.end <= b.start for a, b in zip(found, found[1:], strict=False))


def plainly_settled(found):
    found = list(set(found))
    alone = [f for f in found if not any(g != f and g[0] <= f[0] and f[1] <= g[1] and ((g[1] - g[0] > f[1] - f[0]) or (-g[2], g[3]) < (-f[2], f[3])) for g in found)]
    kept = []
    for f in sorted(alone, key=lambda f: (-f[2], f[0] - f[1], f[3], f[0])):
        if all(f[1] <= g[0] or g[1] <= f[0] for g in kept):
            kept.append(f)
    return sorted(kept)


def test_overlaps_are_settled_as_stated():
    r = random.Random(6)
    for _ in range(300):
        found = [(a := r.randrange(20), a + r.randrange(1, 8), r.randrange(1, 5), k, str(k)) for k in range(r.randrange(9))]
        assert licenses.settled(found) == plainly_settled(found)


def test_the_prefilter_loses_nothing():
    r, parts = random.Random(7), [*NOTICES, "some words between", "all rights reserved", "under the terms of the"]
    for _ in range(40):
        joined = licenses.normalised(" ".join(r.choice(parts) for _ in range(r.randrange(1, 6))))
        words = joined.split()
        want = [(" ".join(words[d.start : d.end]), d.label, d.priority) for d in licenses.detect(joined)[1]]
        assert want == [(joined[a:b], label, p) for a, b, p, _, label in licenses.settled(licenses.matches(joined, licenses.rules()))]


def test_base_columns_equal_sql_over_the_table(spark):
    """All base columns of op4 and op5 over whole tables."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.001/documents.parquet')")
    phrases = " UNION ALL ".join(f"SELECT doc_id, i - 1 AS spot FROM w, unnest(range(1, greatest(1, len(words) - {len(p.split()) - 2}))) AS t(i) WHERE array_to_string(words[i:i+{len(p.split()) - 1}], ' ') = '{p}'" for p, _ in licenses.BASE)
    sql = rf"""WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
        p AS ({phrases}) SELECT w.doc_id, len(words), count(spot), min(spot), max(spot) FROM w LEFT JOIN p USING (doc_id) GROUP BY w.doc_id, words"""
    got = [tuple(r)[:5] for r in licenses.op5_licenses(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word").collect()]
    assert sorted(got, key=str) == sorted(con.execute(sql).fetchall(), key=str) and any(r[2] for r in got)
    sql = r"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
        d AS (SELECT doc_id, sum(n - 1) AS dups FROM (SELECT doc_id, line, count(*) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL) GROUP BY doc_id),
        g AS (SELECT doc_id, i, words[i:i+2] AS gram FROM w, unnest(range(1, greatest(1, len(words) - 1))) AS t(i)),
        o AS (SELECT g.doc_id, i FROM g JOIN (SELECT doc_id, gram FROM g GROUP BY ALL HAVING count(*) > 1) m ON g.doc_id = m.doc_id AND g.gram = m.gram),
        r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM o, range(3) AS t(k) GROUP BY doc_id)
        SELECT w.doc_id, len(words), len(array_to_string(words, '')), len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')), coalesce(dups, 0), coalesce(n, 0), len(words) < 50 OR 100 * coalesce(n, 0) > 50 * len(words)
        FROM w LEFT JOIN d USING (doc_id) LEFT JOIN r USING (doc_id)"""
    judged = quality.judge(docs, quality.EMPTY).select("doc_id", "kd_words", "kd_word_chars", "kd_symbols", "kd_dup_lines", "kd_repeat_words", "kd_failed")
    assert sorted(map(tuple, judged.collect()), key=str) == sorted((tuple(map(int, r[:6])) + (r[6],) for r in con.execute(sql).fetchall()), key=str)


def test_license_query(odd_docs):
    rows = licenses.op5_licenses(odd_docs).collect()
    assert len(rows) == 10 and all(r.n_base == 0 and r.first_word is None and r.score == 0 for r in rows)


# ---- toxicity


def test_toxicity_learns_and_holds_out(spark, odd_docs):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.op6_toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    positive = [r.score for r in rows if r.toxic]
    negative = [r.score for r in rows if not r.toxic]
    auc = np.mean([[p > n for n in negative] for p in positive])
    caught = [r for r in rows if r.predicted]
    assert auc > 0.95 and len(caught) > 0.6 * len(positive) and sum(r.toxic for r in caught) > 0.95 * len(caught)
    assert all(toxicity.crc_held_out(r.doc_id) for r in rows)
    none = toxicity.op6_toxicity(odd_docs, labels.limit(0)).collect()
    assert len(none) == 10 and len({r.score for r in none}) == 1 and zlib.crc32(b"1") % 3 in (0, 1, 2)


def plain_ftrl(rows, s):
    """FTRL-proximal a feature at a time, with dictionaries."""
    seen = Counter(i for at, _ in rows for i in at)
    rows = [([i for i in at if seen[i] >= s.min_rows], y) for at, y in rows]
    positive, z, n = sum(y for _, y in rows), {}, {}
    start = bias = math.log((positive + 1) / (len(rows) - positive + 1))
    weight = lambda i: 0.0 if abs(z.get(i, 0)) <= s.l1 else -(z[i] - math.copysign(s.l1, z[i])) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)
    bz = bn = 0.0
    for _ in range(s.epochs):
        for at, y in rows:
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-(sum(w.values()) + bias))) - y
            for i in at:
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / s.alpha * w[i]
                n[i] = old + g * g
            bz, bn = bz + g, bn + g * g
            bias = start - bz * s.alpha / (s.beta + math.sqrt(bn)) / 4
    return {i: w for i in z if (w := weight(i))}, bias


def test_fit_and_score_equal_a_plain_version(spark):
    r, s = random.Random(9), toxicity.Settings(l1=0.3, min_rows=2, epochs=3)
    texts = [" ".join(r.choice(["good", "fine", "bad", "awful", "a", "the"][(k % 2) * 2 :]) for _ in range(12)) for k in range(40)]
    rows = [(x, k % 2) for k, x in enumerate(toxicity.distinct_features(texts, s.bits))]
    at, w, bias = toxicity.fit(rows, s)
    want, start = plain_ftrl([(x.tolist(), y) for x, y in rows], s)
    assert dict(zip(at.tolist(), w.tolist(), strict=True)) == pytest.approx(want) and bias == pytest.approx(start) and 0 < len(want) < 1000
    df = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.kd_score for x in toxicity.score(df, (at, w, bias), s).collect()}
    for k, (x, _) in enumerate([*rows, (np.zeros(0, int), 0)]):
        assert got[k if k < 40 else 99] == pytest.approx(1 / (1 + math.exp(-(sum(want.get(i, 0) for i in x.tolist()) + start))), abs=1e-5)


def test_clashing_columns_of_text_operators(clashing):
    for made, more in (
        (pieces.count_tokens(clashing), ["kd_tokens"]), (pieces.decode(pieces.encode(clashing)), ["kd_ids", "kd_text"]), (toxicity.score(clashing, (np.zeros(0), np.zeros(0), 0.0)), ["kd_score"]),
        (licenses.scan(clashing).select("*"), ["kd_words", "kd_base", "kd_first", "kd_last", "kd_base_labels", "kd_labels", "kd_score", "kd_spans"]),
        (quality.judge(clashing, quality.EMPTY), ["kd_words", "kd_word_chars", "kd_symbols", "kd_dup_lines", "kd_repeat_words", "kd_failed", "kd_share", "kd_kept", "kd_labels"]),
    ):
        assert made.columns == [c for c in clashing.columns if c.lower() not in more] + more and {r.KD_KEY for r in made.collect()} == {"x"} and made.count() == 6


def test_toxicity_features():
    row, feature = toxicity.features(["A b, c", None, "a"], 22)
    assert Counter(row.tolist()) == {0: 6, 2: 1} and feature[0] == feature[3] and feature.max() < 1 << 22


# ---- pieces


def test_counts_equal_the_library(spark, odd_docs):
    from tokenizers import Tokenizer, models, normalizers

    v = pieces.vocabulary(pieces.default_model())
    lib = Tokenizer(models.Unigram(list(zip(v.pieces, v.scores, strict=True)), unk_id=0, byte_fallback=True))
    lib.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    texts = [*ODD, *(prose(i, 60) for i in range(20)), "aaaa" * 50, "Привет мир"]
    assert pieces.Counter(v).counts(texts) == [len(lib.encode(t, add_special_tokens=False).ids) if t else 0 for t in texts]
    assert {r.n_tokens for r in pieces.op8_token_counts(odd_docs).where("doc_id in (2, 3)").collect()} == {0}


def test_sampling_is_reproducible_lossless_and_in_proportion():
    v = pieces.vocabulary(pieces.default_model())
    a, b = pieces.Sampler(v, 1.0), pieces.Sampler(v, 1.0)
    texts = [*ODD, prose(1, 400), "x" * 300 + "ñ" * 90]
    ids = a.encode(texts, list(range(len(texts))))
    spelt = pieces.spellings(v)
    assert [b"".join(spelt[i] for i in x).decode() for x in ids] == texts
    for k in reversed(range(len(texts))):
        assert (b.encode([texts[k]], [k])[0] == ids[k]).all()
    # all segmentations of a word by hand
    rank, word = {v.pieces[i].replace("▁", " "): r for r, i in enumerate(v.normal)}, "there"

    def paths(w):
        return [([], 1.0)] if not w else [([w[:n], *p], q / (rank[w[:n]] + 1)) for n in range(1, len(w) + 1) if w[:n] in rank for p, q in paths(w[n:])]

    every = paths(word)
    whole = sum(q for _, q in every)
    drawn = Counter(tuple(spelt[i].decode() for i in x) for x in a.encode([word] * 20_000, list(range(20_000))))
    for p, q in every:
        assert abs(drawn[tuple(p)] / 20_000 - q / whole) < 0.02


def plain_sample(v, text, seed):
    """One text's sampled ids, word by word, with dictionaries."""
    rank, mask, out = {v.pieces[i].replace("▁", " "): (r, i) for r, i in enumerate(v.normal)}, (1 << 64) - 1, []

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    for place, word in enumerate(pieces.Sampler.parts(text)):
        total, into, own = [1.0], [[]], []
        for end in range(1, len(word) + 1):
            edges = [(total[a] / (rank[word[a:end]][0] + 1), a, rank[word[a:end]][1]) for a in range(max(0, end - 16), end) if word[a:end] in rank]
            if word[end - 1] not in rank:
                edges.append((total[end - 1] / (len(v.pieces) + 1), end - 1, -1))
            total.append(sum(p for p, _, _ in edges))
            into.append(edges)
        start, at, step = mixed((seed + place * 0x9E3779B97F4A7C15) & mask), len(word), 1
        while at:
            draw, running = mixed((start + step * 0xD1B54A32D192ED03) & mask) >> 32, 0
            for p, a, i in into[at][:-1]:
                running += int(p / total[at] * 4294967295.0)
                if running > draw:
                    break
            else:
                _, a, i = into[at][-1]
            own[:0] = [i] if i >= 0 else [v.byte_ids[b] for b in word[at - 1].encode()]
            at, step = a, step + 1
        out += own
    return out


def test_sampling_equals_a_plain_version_whatever_was_learnt_before(monkeypatch):
    v, r = pieces.vocabulary(pieces.default_model()), random.Random(5)
    parts = ["a", "ab", "the", "there", "\x00", " ", "  ", "\n", "é", "日", "🙂", "▁", "ing", "Привет", "x" * 15, "\uffff"]
    texts = [*ODD, None, *("".join(r.choices(parts, k=r.randrange(1, 30))) for _ in range(600)), *(prose(i, 40) for i in range(10)), "ab" * 24, "ab" * 24 + "c", "\x00", "a\x00", "a", "a\x00\x00"]
    seeds = [r.randrange(-(1 << 63), 1 << 63) for _ in texts]
    want = [plain_sample(v, t or "", s) for t, s in zip(texts, seeds, strict=True)]
    a = pieces.Sampler(v, 1.0)
    assert [x.tolist() for x in a.encode(texts, seeds)] == want and [x.tolist() for x in a.encode(texts[::-1], seeds[::-1])] == want[::-1]
    monkeypatch.setattr(pieces, "WORDS", 50)
    b = pieces.Sampler(v, 1.0)
    assert [b.encode([t], [s])[0].tolist() for t, s in zip(texts, seeds, strict=True)] == want and len(b.numbers) < 150


def test_words_learnt_together_share_the_nodes_of_common_beginnings():
    r = random.Random(8)
    words = {"".join(r.choices("abc", k=r.randrange(1, 9))) for _ in range(5000)}
    a = pieces.Sampler(pieces.vocabulary(pieces.default_model()), 1.0)
    a.encode(["\n".join(sorted(words)), "\n".join(words)], [1, 2])
    beginnings = {w[:k] for w in words for k in range(1, len(w) + 1)} | {"\n"}
    assert a.nodes == len(beginnings) + 1 < sum(map(len, words)) // 2


def test_encode_and_decode_frames(odd_docs):
    encoded = pieces.encode(odd_docs)
    back = pieces.decode(encoded)
    assert all(r.text == r.kd_text for r in back.select("text", "kd_text").collect()) and encoded.columns[:-1] == odd_docs.columns
    rows = pieces.op9_sentencepiece(odd_docs).collect()
    assert len(rows) == 10 and all(r.lossless for r in rows) and pieces.op9_sentencepiece(odd_docs.limit(0)).count() == 0
