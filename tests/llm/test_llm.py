"""The training-data operators against brute force, with nulls, empty tables, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

import corpus_pipeline
from hearthmark.llm import bpe, chat, fingerprint, html, language, mixing, neighbours, quality, queries, simhash, tokenid
from hearthmark.llm.common import components

SF = "/root/testdata/sf0.001"
RANKS = P.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, key long, bucket int, x double, fp long, size long"
TEXTS = [(1, "Hello world,\n it's 42 漢字!"), (2, None), (3, ""), (4, "a" * 5000 + " b"), (5, "same text here again"), (6, "same text here again"), (6, "same text here again"), (None, "no id   \t\n"), (7, "...!!!")]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame([(i, t, "en" if k % 2 else None, "s" if k % 3 else None, len(t or ""), "x", 1, 2, 0.5, 3, 4) for k, (i, t) in enumerate(TEXTS)], DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def tik():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_bpe_equals_tiktoken(spark, docs, none, texts):
    e = tik()
    got = bpe.decode(bpe.encode(docs, RANKS), RANKS).collect()
    want = sorted((str(i), e.encode_ordinary(t or ""), (t or "").encode()) for i, t in TEXTS)
    assert sorted((str(r["doc_id"]), r["ids"], bytes(r["decoded"])) for r in got) == want
    assert bpe.encode(none, RANKS).count() == 0
    for r in queries.op1_byte_bpe(spark, SF).collect():
        ids = e.encode_ordinary(texts[r["doc_id"]])
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_fingerprints(spark, docs, none):
    of = lambda t: fingerprint.to_hex(fingerprint.vector(t))
    assert of("one para\ntwo para") == of("two para\n\none para") != of("one para")
    assert fingerprint.combine(of("one para"), of("two para")) == of("one para\ntwo para")
    assert fingerprint.combine(of("one para\ntwo para"), of("two para"), -1) == of("one para")
    assert fingerprint.compare_next(none).count() == 0
    got = fingerprint.compare_next(docs).collect()
    assert len(got) == len(TEXTS)
    order = sorted([(-i, t or "") for i, t in TEXTS if i is not None]) + [(None, t) for i, t in TEXTS if i is None]
    want = []
    for (i, a), (_, b) in zip(order, order[1:] + order[:1], strict=True):
        cut = len(a) // 3
        want.append((-i if i is not None else None, hashlib.sha256((a[: len(a) - cut] + b[:cut]).encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["edited_sha256"])) for r in got)


def test_preferences(spark):
    rows = spark.createDataFrame([(0, 0, "user", "hi"), (0, 1, "assistant", "yo"), (1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 0, None, "alone"), (3, None, "system", "s")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.preferences(chat.swapped_pairs(chat.conversations(rows))).collect()}
    assert got[0]["prompt"] == "<|user|>\nhi\n<|end|>\n" and got[0]["chosen"] == "<|assistant|>\nyo\n<|end|>\n" and got[0]["rejected"] == "<|assistant|>\n\n<|end|>\n"
    assert [tuple(s) for s in got[0]["chosen_spans"]] == [(14, 25)]
    assert got[2]["chosen"] == got[2]["rejected"] == "" and got[2]["prefix_turns"] == 1
    assert chat.conversations(rows.limit(0)).count() == 0


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.classify(none, labels).count() == 0
    out = quality.classify(docs, labels).collect()
    assert len(out) == len(TEXTS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    got = {r["doc_id"]: r for r in queries.op4_quality(spark, "/root/testdata/sf0.01").collect()}
    held = [(r["quality"], got[r["doc_id"]]["predicted"]) for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([a == b for a, b in held]) >= 0.95


def test_token_ids(spark, docs, none, tmp_path):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for name, table, rows in (("some", docs, TEXTS), ("none", none, [])):
        path = str(tmp_path / name)
        tokenid.write_ids(table, path, P.path("byte_bpe_50k.json"), block_bytes=3000)
        got = sorted((r["start"], r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in tokenid.read_ids(spark, path).collect())
        order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
        want, at = [], 0
        for i, text in order:
            ids = t.encode(text or "", add_special_tokens=False).ids + [0]
            want.append((at, i, ids))
            at += len(ids)
        assert got == want
    values = np.sort(np.random.default_rng(0).integers(0, 100_000, 3000))
    ef = tokenid.EliasFano.of(values)
    for a, b in [(0, 3000), (0, 0), (5, 6), (63, 65), (64, 128), (2900, 3000), (2999, 3000), *((i, min(3000, i + 97)) for i in range(0, 3000, 89))]:
        assert ef.select(a, b).tolist() == values[a:b].tolist()
    same = tokenid.EliasFano.of(np.zeros(130, np.int64))
    assert same.select(1, 130).tolist() == [0] * 129 and tokenid.EliasFano.of(np.zeros(0, np.int64)).select(0, 0).tolist() == []


def test_html(spark):
    page = '<body><nav>menu</nav><header>top</header><div class="main"><article><h1>T&amp;c</h1><p>One\n two<p>Three <a href="/x">link</a></article></div><div class="ad">buy</div><section id="comments"><p>bad</p></section><footer>f</footer>'
    rows = spark.createDataFrame([(1, "http://a.com/1", page), (2, "http://a.com/2", None), (3, None, ""), (4, "http://a.com/3", page.replace("One", "<script>x</script>Uno"))], "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.main_text(rows).collect()}
    assert got == {1: ("T&c\n\nOne two\n\nThree link", 24), 2: ("", 0), 3: ("", 0), 4: ("T&c\n\nUno two\n\nThree link", 24)}
    assert html.main_text(rows.limit(0)).count() == 0


def test_html_keeps_article_text_outside_the_largest_container(spark):
    pages = {
        "<body><h1>T</h1><p>One one one.</p><blockquote>Two two two two.</blockquote><p>Three.</p><nav>menu</nav></body>": "T\n\nOne one one.\n\nTwo two two two.\n\nThree.",
        "<body><div class=a><p>First half.</p></div><div class=b><p>Second half, longer.</p></div><footer>f</footer></body>": "First half.\n\nSecond half, longer.",
        f"<body><div class=p><h1>T</h1><div class=s><p>{'long ' * 200}</p></div></div></body>": "T\n\n" + ("long " * 200).strip(),
        "<body><div class=s><p>Story.</p></div><ul><li><a href=/x>elsewhere</a></ul></body>": "Story.",
    }
    for page, text in pages.items():
        assert html.extract(page) == text
    other = "<body><div class=t><p>Short.</p></div><div class=u><p>A much longer story stands here.</p></div></body>"
    rows = spark.createDataFrame([(i, "http://a.com/x", "<body><div class=t><p>Mine.</p></div></body>" if i else other) for i in range(4)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html.main_text(rows).collect()}[0] == "Short.\n\nA much longer story stands here."


def test_html_leaves_out_by_whole_names_and_evidence():
    cases = {
        '<div class="content has-sidebar"><article><h1>T</h1><p>Body text</p></article></div>': "T\n\nBody text",
        "<body><form action=x><p>Long body text here.</p><p>More</p></form></body>": "Long body text here.\n\nMore",
        '<main><section class="social-science"><p>Text one</p></section></main>': "Text one",
        '<article><div class="entry-header"><h1>Title</h1></div><p>Body</p></article>': "Title\n\nBody",
        '<main><p>hi</p></main><div class="comments-area"><article><p>nasty</p></article></div>': "hi",
        '<article class="comment"><p>bad</p></article><p>story</p>': "story",
        '<div class="site-header"><p>x</p></div><p>story</p>': "story",
        "<div><p>story text</p><form><p>name</p></form></div>": "story text",
        '<div class="related-posts"><article>tease</article></div><article>story</article>': "story",
        "<p>unclosed <b>text <script>zzz": "unclosed text",
        "<p>a &lt;b&gt; &amp; c&nbsp;d<!-- <p>no": "a <b> & c d",
    }
    for page, text in cases.items():
        assert html.extract(page) == text, page
    deep = html.extract("<div>" * 20_000 + "end" + "<p>x" * 2000)
    assert deep == "\n\n".join(["end", *["x"] * 2000])
    assert len(html.extract("<p>" + "word " * 400_000)) == 5 * 400_000 - 1


def test_html_leaves_out_what_pages_show_only_in_odd_markup():
    cases = {
        '<div class="a><p>Lost text?': "Lost text?",
        '<p>story</p><div class="cc-window">We use cookies. Accept</div>': "story",
        '<p>story</p><ul id="commentlist"><li>x</ul>': "story",
        '<p>story</p><section class="user-comments-thread"><p>x</section>': "story",
        '<p>story</p><div class="dfp-unit">Buy now</div>': "story",
        '<article><section class="notices"><p>Only text</section></article>': "Only text",
        "<p>Let <math><mi>x</mi></math> be</p>": "Let x be",
        "<div>" * 511 + "<aside>AD<div><p>promo text": "",
        "<div>" * 900 + "<p>deep": "deep",
        "<a href=x>one<a href=y>two</a><p>story": "onetwo\n\nstory",
    }
    for page, text in cases.items():
        assert html.extract(page) == text, page


def test_html_takes_linear_time():
    import time

    for page in ("<body><form>" + "<p>some words here</p>" * 20_000 + "</form>", '<div class="promo">' + "<article><p>x y</p></article>" * 20_000, "<div><p>ab" * 20_000, "<b>" * 20_000 + "<p>x</p>" * 20_000, "<div>" * 20_000 + "x</span>" * 20_000):
        start = time.time()
        assert html.extract(page)
        assert time.time() - start < 10  # under a second where nothing else runs


def brute_main_text(rows):
    """Votes and templates counted page by page, straight from the blocks."""
    hosts = {}
    for _, url, page in rows:
        host = re.sub(r"^https?://([^/]*).*", r"\1", url) if url else ""
        boxes, found = html.blocks(page)
        chain, best = html.scored(boxes, found)
        if chain:
            node, a, b = chain[best]
            votes, seen = hosts.setdefault(host, (Counter(), {}))
            votes[node.path] += 1
            for i, (n, words, _) in enumerate(found):
                if not a <= i < b:
                    own = seen.setdefault(n.path, (set(), set()))
                    own[0].add(tuple(w for _, w, _ in found[a:b]))
                    own[1].add(words)
    out = []
    for key, url, page in rows:
        host = re.sub(r"^https?://([^/]*).*", r"\1", url) if url else ""
        votes, seen = hosts.get(host, (Counter(), {}))
        winners = [p for p, n in sorted(votes.items(), key=lambda x: (-x[1], x[0])) if n >= 0.2 * sum(votes.values())]
        boxes, found = html.blocks(page)
        chain, best = html.scored(boxes, found)
        by_path = {}
        for n, a, b in chain:
            by_path.setdefault(n.path, (a, b))
        a, b = next((by_path[w] for w in winners if w in by_path), chain[best][1:] if chain else (0, 0))
        template = {p for p, (pages, texts) in seen.items() if len(pages) >= 3 and 2 * len(texts) <= len(pages)}
        text = "\n\n".join(w for i, (n, w, linked) in enumerate(found) if a <= i < b or (2 * linked <= len(w) and n.path not in template))
        out.append((key, url, text, len(text)))
    return out


def consensus_pages():
    story = lambda i: f"<div class=story><p>Story {i} tells a long tale of its own, {i * 37} words and more.</p><p>{'And it goes on. ' * 9}</p></div>"
    strip = "<div class=zone><p>All rights with the house.</p></div>"
    rows = [(i, "http://a.com/x", f"<body><h2>Lead {i}</h2>{story(i)}{strip}</body>") for i in range(6)]  # the strip is the same on all pages: template
    rows += [(10 + i, "http://b.com/x", f"<body>{story(7)}{strip}</body>") for i in range(6)]  # copies of one page show no template
    rows += [(20 + i, "http://c.com/x", f"<body>{story(i)}<div class=zone><p>Note {i}.</p></div></body>") for i in range(6)]  # notes differ
    rows += [(30, "http://a.com/y", f"<body><section><p>{'Another make of page. ' * 9}</p></section>{strip}</body>"), (31, "http://a.com/z", f"<body>{strip}</body>"), (32, None, None), (33, "http://a.com/l", "<body><ul><li><a href=x>all</a><li><a href=y>links</a></ul></body>")]
    return rows


def test_html_consensus_narrows_pages_only_where_the_host_shows_a_template(spark):
    rows = consensus_pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.main_text(df).collect()}
    assert all(f"Lead {i}" in got[i] and "rights" not in got[i] for i in range(6))
    assert all("rights" in got[10 + i] and f"Note {i}." in got[20 + i] for i in range(6))
    assert "rights" not in got[30] and got[30].startswith("Another") and got[31] == "All rights with the house."
    assert got[33] == "all\n\nlinks"
    assert all("rights" in html.extract(rows[i][2]) for i in range(6))  # by itself a page cannot know


def test_html_equals_brute_force(spark):
    df = spark.createDataFrame(consensus_pages() * 2, "page_id long, url string, html string").unionByName(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html"))
    rows = [tuple(r) for r in df.collect()]
    assert sorted(map(str, map(tuple, html.main_text(df).collect()))) == sorted(map(str, brute_main_text(rows)))


def test_html_reads_clashing_columns_repeated_rows_and_null_ids(spark):
    page = "<body><article><p>Story.</p></article></body>"
    rows = spark.createDataFrame([(k, "http://h.com/a", page, "host", 1, "p") for k in (1, 1, None, 2)], "page_id long, url string, html string, host string, salt int, words string")
    got = html.main_text(rows).collect()
    assert sorted(map(str, (r["page_id"] for r in got))) == ["1", "1", "2", "None"] and {(r["text"], r["n_chars"]) for r in got} == {("Story.", 6)}


def test_likeness_is_near_the_share_of_common_windows():
    words = [f"word{i}" for i in range(2000)]
    text = lambda w: "\n".join(" ".join(w[i : i + 20]) for i in range(0, len(w), 20))
    windows = lambda t: Counter(p[i : i + 16] for p in fingerprint.paragraphs(t) for i in range(max(1, len(p) - 15)))
    a = text(words)
    for k in (0, 200, 700, 1400, 2000):
        b = text([f"other{i}" for i in range(k)] + words[k:])
        x, y = windows(a), windows(b)
        both = sum((c - y[w]) ** 2 for w, c in x.items()) + sum(c * c for w, c in y.items() if w not in x)
        exact = 1 - both / (sum(c * c for c in x.values()) + sum(c * c for c in y.values()))
        assert abs(fingerprint.likeness(fingerprint.vector(a), fingerprint.vector(b)) - exact) < 0.25
    line = "the same line again " * 2
    many = fingerprint.likeness(fingerprint.vector("\n".join([line] * 70_000)), fingerprint.vector("\n".join([line] * 60_000)))
    assert 0.95 < many < 1  # far more windows of a kind than two bytes hold


def test_quality_scores_equal_a_dense_discriminant(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    marks = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = {r["doc_id"]: quality.statistics(r["text"]) for r in docs.collect()}
    learn = [i for i in rows if i in marks and zlib.crc32(str(i).encode()) % 5]
    x, y = np.array([rows[i] for i in learn]), np.array([marks[i] for i in learn])
    spread = sum(((x[y == k] - x[y == k].mean(axis=0)) ** 2).sum(axis=0) for k in (0, 1)) / len(y)
    logs = []
    for k in (0, 1):
        own = x[y == k]
        low = min(1.0, quality.SHRINK + x.shape[1] / (x.shape[1] + len(own)))
        cov = (1 - low) * np.cov(own.T, bias=True) + low * np.diag(np.maximum(spread, 1e-4))
        away = np.array([*rows.values()]) - own.mean(axis=0)
        logs.append(np.log((len(own) + 1) / (len(y) + 2)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * (away @ np.linalg.inv(cov) * away).sum(axis=1))
    want = dict(zip(rows, 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700))), strict=True))
    got = {r["doc_id"]: r["score"] for r in queries.op4_quality(spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in got)


def test_languages_equal_direct_cosines(spark):
    docs = [(r["doc_id"], r["lang"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2, (language.SYMBOLS, language.WIDTH)) * 2 - 1

    def profile(text):
        codes = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        out = np.zeros(language.WIDTH)
        row = " " + " ".join(codes) + " "
        number = lambda c: 0 if c == " " else ord(c) if ord(c) < 0x250 else 0x250 + ord(c) % (language.SYMBOLS - 0x250)
        for a, b, c in zip(row, row[1:], row[2:], strict=False):
            out += np.roll(base[number(a)], 2) * np.roll(base[number(b)], 1) * base[number(c)]
        return out / (np.linalg.norm(out) or 1)

    own = {i: profile(t) for i, _, t in docs if any(map(str.isalpha, t or ""))}
    sums = {}
    for i, lang, _ in docs:
        if i in own and lang is not None and zlib.crc32(str(i).encode()) % 5:
            sums[lang] = sums.get(lang, 0) + own[i]
    protos = {k: v / np.linalg.norm(v) for k, v in sums.items()}
    mean = np.mean([*protos.values()], axis=0)
    got = {r["doc_id"]: r["lang_pred"] for r in queries.op9_language(spark, SF).collect()}
    for i, _, _ in docs:
        cos = {k: (own[i] - mean) @ (v - mean) / np.linalg.norm(v - mean) / np.linalg.norm(own[i] - mean) for k, v in protos.items()} if i in own else {}
        best = sorted(cos.values())[-2:]
        assert got[i] == (max(cos, key=cos.get) if cos else "und") or best[1] - best[0] < 1e-3


def test_preferences_with_clashing_columns_repeated_rows_and_long_texts(spark):
    long = "x" * 300_000
    rows = spark.createDataFrame([(0, 0, "user", long, "p"), (0, 1, "assistant", "yo", "c"), (0, 1, "assistant", "yo", "c"), (1, 0, "user", "hi", "r"), (1, 1, "assistant", "no", "last")], "conv_id long, turn long, role string, text string, last string")
    got = {r["conv_id"]: r for r in chat.preferences(chat.swapped_pairs(chat.conversations(rows)).withColumn("p", F.lit(7))).collect()}
    assert got[0]["p"] == 7 and got[0]["prefix_turns"] == 2 and got[0]["prompt"].count("<|assistant|>") == 1 and len(got[0]["prompt"]) > 300_000
    assert got[0]["chosen"] == "<|assistant|>\nyo\n<|end|>\n" and got[0]["rejected"] == "<|assistant|>\nno\n<|end|>\n"


def test_stored_tables_can_be_released(spark):
    from hearthmark.llm import common

    table = common.stored(spark.range(5), "five")
    assert table.count() == 5
    common.drop(table)
    kept = common.stored(spark.range(5).withColumn("k", F.col("id") % 2), "kept", bucket_by="k")
    assert kept.groupBy("k").count().count() == 2
    common.release(spark)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("stored_")]


def test_mixing(spark, docs, none):
    assert mixing.mix_report(none).count() == 0
    got = mixing.mix_report(docs).collect()
    assert len(got) == len(TEXTS) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    rows = spark.createDataFrame([(i, "w " * (i % 7 + 1), "big" if i % 3 else f"s{i % 5}") for i in range(300)], "doc_id long, text string, source string")
    a = mixing.assign(rows).collect()
    assert sorted(map(str, a)) == sorted(map(str, mixing.assign(rows.repartition(3)).collect()))
    by = {}
    for r in a:
        by.setdefault(r["source"], [r["target"], 0])[1] += r["taken"]
    assert all(t - 1 <= taken <= t for t, taken in by.values()) and abs(sum(t for t, _ in by.values()) - 1.5 * sum(r["size"] for r in a)) < 1e-6


def test_simhash(spark, docs, none):
    def slow(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    for _, t in TEXTS:
        assert simhash.simhash(t) == slow(t)
    got = simhash.cluster(docs).collect()
    assert len(got) == len(TEXTS) and {r["component_id"] for r in got if r["doc_id"] == 6} == {5}
    assert {r["component_id"] for r in got if r["doc_id"] in (2, 3)} == {2}
    assert simhash.cluster(none).count() == 0 and simhash.representatives(none).count() == 0
    rng = np.random.default_rng(2)
    values = rng.integers(0, 2**63, 40).astype(np.uint64)
    values = np.unique(np.concatenate([values, values ^ np.uint64(1), values ^ np.uint64(6), values ^ np.uint64(7 << 40)]))
    nodes = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    for large in (20_000, 1):  # also with every shard dealt out again
        label = np.arange(len(values))
        for i in range(len(values)):
            near = np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 2)
            simhash.unite(label, np.full(len(near), i), near)
        found = {r["node"]: r["root"] for r in components(simhash.near_links(nodes, large=large)).collect()}
        root = [found.get(int(v), int(v)) for v in values.view(np.int64)]
        assert len(set(root)) == len(set(label)) and all((root[i] == root[j]) == (label[i] == label[j]) for i in range(0, len(root), 7) for j in range(len(root)))


def test_language(spark, docs, none):
    assert language.identify(none).count() == 0
    got = {r["doc_id"]: r for r in language.identify(docs).collect()}
    assert got[2]["lang_pred"] == got[3]["lang_pred"] == got[7]["lang_pred"] == "und"
    held = [(r["lang"], r["lang_pred"]) for r in queries.op9_language(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect() if r["held_out"]]
    assert np.mean([a == b for a, b in held]) >= 0.97


def test_neighbours(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in table.collect()}
    ids, x = np.array([*rows]), np.stack([*rows.values()])
    hit, got = 0, {}
    for r in queries.op10_neighbours(spark, "/root/testdata/sf0.01").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    for q, found in got.items():
        s = np.where(ids == q, -np.inf, x @ rows[q])
        hit += len({v for _, v in found} & set(ids[np.argsort(-s)[:20]].tolist()))
    assert hit >= 0.9 * 20 * len(got) and len(got) == sum(i % 20 == 0 for i in rows)
    odd = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [0.0, 2.0]), (None, [1.0, 1.0]), (8, [1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in neighbours.nearest(odd, F.col("vec_id") % 20 == 0).orderBy("rank").collect()] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 6, 0.0)]
    assert neighbours.nearest(odd.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_neighbours_in_many_small_leaves_with_repeated_ids_and_clashing_columns(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.standard_normal((600, 8)), 2)
    x[100:160] = x[7]  # a group of equal vectors
    rows = [(int(i % 590), v.tolist(), 1.0, 2, "p") for i, v in enumerate(x)]  # ids 0 to 9 stand for two vectors each
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v double, part int, qid string")
    got = {}
    for r in neighbours.nearest(table, F.col("vec_id") % 50 == 20, k=5, leaf=40).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ids, hit = np.array([r[0] for r in rows]), 0
    for q, found in got.items():
        own = {}
        for i in np.flatnonzero(ids != q):
            s = float((x[i] * x[q]).sum())
            own[int(ids[i])] = max(s, own.get(int(ids[i]), -np.inf))
        want = sorted(own.items(), key=lambda t: (-t[1], t[0]))[:5]
        assert [r for r, _, _ in sorted(found)] == [1, 2, 3, 4, 5]
        hit += len({i for i, _ in want} & {i for _, i, _ in found})
    assert len(got) == 12 and hit >= 0.9 * 60


def test_stages_keep_clashing_columns_and_empty_tables(spark, docs, none):
    for name, stage in corpus_pipeline.STAGES[:4]:
        for table in (docs, none):
            out = stage(spark, table, SF)
            assert out.columns == docs.columns and out.count() <= 2 * table.count(), name
            assert {r["x"] for r in out.collect()} <= {0.5}


def test_pipeline_drops_near_copies_and_keeps_what_is_less_alike(spark):
    words = [f"w{i}" for i in range(400)]
    cut = lambda k, tag: " ".join(f"{tag}{i}" if i % (400 // k) == 7 else w for i, w in enumerate(words))
    texts = [" ".join(words), cut(4, "x"), cut(8, "y"), cut(25, "z"), " ".join(f"v{i}" for i in range(300)), " ".join(words).upper()]
    rows = spark.createDataFrame([(i, t, None, None, len(t), "x", 1, 2, 0.5, 3, 4) for i, t in enumerate(texts)], DOCS)
    assert sorted(r["doc_id"] for r in corpus_pipeline.dedup_stage(spark, rows, SF).collect()) == [0, 3, 4]  # against 0: 0.90, 0.82, 0.52, 0, 1
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    grams, at, hits, root = {}, {}, {}, {}
    for r in docs.collect():
        w = (r["text"] or "").encode().lower().split()
        grams[r["doc_id"]] = {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    for i in sorted(grams):
        root[i], hits = i, {}
        for g in grams[i]:
            for j in at.setdefault(g, []):
                hits[j] = hits.get(j, 0) + 1
            at[g].append(i)
        for j, n in hits.items():
            if n >= 0.8 * (len(grams[i]) + len(grams[j]) - n):
                low, high = sorted((root[i], root[j]))
                root = {k: low if v == high else v for k, v in root.items()}
    assert sorted(r["doc_id"] for r in corpus_pipeline.dedup_stage(spark, docs, SF).collect()) == sorted(set(root.values()))


def test_near_copies_are_found_by_fingerprints(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40).tolist()
    fps = [*base, base[0], *(f ^ sum(1 << int(b) for b in rng.choice(62, k, replace=False)) for f in base for k in (1, 3, 4))]
    rows = [(i.to_bytes(2, "big"), f) for i, f in enumerate(fps)]
    got = simhash.near_by_fingerprint(spark.createDataFrame(rows, "tk binary, fp long"))
    found = {bytes(r["node"]): bytes(r["root"]) for r in components(got).collect()}
    label = np.arange(len(fps))
    for i, f in enumerate(fps):
        near = np.flatnonzero(np.bitwise_count(np.array(fps) ^ f) <= 3)
        simhash.unite(label, np.full(len(near), i), near)
    assert {t: found.get(t, t) for t, _ in rows} == {t: rows[k][0] for (t, _), k in zip(rows, label.tolist())}
    assert len(found) > 80


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF).collect()
    e, texts = tik(), {r["doc_id"]: r["text"] for r in docs.collect()}
    assert out and all(r["ids_sha256"] == hashlib.sha256(" ".join(map(str, e.encode_ordinary(texts[r["doc_id"]]))).encode()).hexdigest() for r in out)
    assert {r["doc_id"] for r in out} < {r["doc_id"] for r in docs.collect()}
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs.limit(0), SF).count() == 0
    odd = spark.createDataFrame([(1, None), (1, ""), (None, "a b")], "doc_id long, text string")
    assert sorted(str((r["doc_id"], r["n_tokens"])) for r in last(spark, odd, SF).collect()) == ["(1, 0)", "(1, 0)", "(None, 2)"]


def odd_texts():
    """Runs of white space, control characters, the mark, special strings, long words, other scripts, new characters."""
    rng = random.Random(5)
    parts = ["a", "b's", " ", "  ", "\n", "\t", "é", "\x1c", "\xa0", "\x85", "\u3000", "7", "!", "'s", "<|endoftext|>", "\r\n", "日本", "😀", "word", "long" * 40, "\0", "\u1c89", "\U00010d40", "'", "\u0378", "ⅷ", "²"]
    return ["", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(3000))]


def test_token_ids_equal_the_library_on_odd_texts():
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        file = f.read()
    library, texts = Tokenizer.from_str(file), odd_texts()
    want = [library.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    for how in (file, file.replace('"add_prefix_space":false', '"add_prefix_space":true').replace('"add_prefix_space": false', '"add_prefix_space": true')):
        library = Tokenizer.from_str(how)
        want = [library.encode(t, add_special_tokens=False).ids + [0] for t in texts]
        ids, ends = tokenid.TextIds(how)(pa.array(texts), 0)
        assert ends.tolist() == np.cumsum([len(w) for w in want]).tolist()
        assert ids.tolist() == [i for w in want for i in w]


def test_pre_tokens_equal_the_library():
    split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    every = [f"a{chr(c)}1 {chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = odd_texts() + every
    got = [[w for w in x if w] for x in bpe.pre_tokens(pa.array(texts)).to_pylist()]
    assert got == [[t[a:b] for _, (a, b) in split(t)] for t in texts]
    words, order, counts = bpe.numbered(pa.array(texts))
    names = words.to_pylist()
    assert "" not in names and [names[i] for i in order] == [w for x in got for w in x] and counts.tolist() == [len(x) for x in got]
    ranks = bpe.read_ranks(RANKS)
    for w in {"".join(x) for x in got[:300]}:  # the heap's merging, which long words take, against the library's
        assert bpe.merge(w.encode(), ranks) == [i for i in tiktoken.Encoding("own", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary(w)] or len(w) > 500


def test_text_blocks_hold_whole_documents():
    def blocks(sizes, most):
        rows = [pa.RecordBatch.from_pydict({"id": pa.array([i for i, _ in part], pa.int64()), "text": pa.array([None if n is None else "x" * n for _, n in part], pa.string())}) for part in sizes]
        return [(ids.to_pylist(), [len(t) for t in texts.to_pylist()]) for ids, texts in bpe.text_blocks(iter(rows), most)]

    assert blocks([], 10) == [] and blocks([[]], 10) == []
    assert blocks([[(1, 3), (2, 3)], [(3, 1), (4, 50), (5, None)]], 10) == [([1, 2, 3], [3, 3, 1]), ([4], [50]), ([5], [0])]


def test_digests_do_not_depend_on_blocks(spark):
    import public_tokenizers

    rows = spark.createDataFrame([(i, "word and number " * (i % 7) + str(i)) for i in range(60)] + [(60, None)], "doc_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = [sorted(map(tuple, bpe.digests(rows, path, public_tokenizers.PATTERN, **how).collect())) for how in ({}, {"block_bytes": 200})]
    assert got[0] == got[1] and len(got[0]) == 61
