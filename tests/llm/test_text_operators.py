"""Encoding, packing, extraction, quality and licences against plain versions; nulls, empty and long texts, repeated rows."""

import base64
import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pricebase.llm import byte_bpe, html_text, license_scan, packing, quality
from tests.conftest import SMALL

RANKS, FILE = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")
ODD = [None, "", " ", "a", "a  b\n \n c ", "日本語 ʰ𐻧x ١٢", "x" * 5000, "word " * 3000, "ab\u0000c <|endoftext|>", "a", "é" * 30]


def frame(spark, texts, **more):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, ids string, part long")


@pytest.fixture(scope="module")
def known():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("known", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_those_of_the_libraries(known):
    random.seed(5)
    parts = [" ", "  ", "\n", " \n", "a", "bc", "é", "1", "½", "!", "'s", "日", " ", "\U0001f600", "\U00010ee7", "ʰ", "٣", "\xa0", "\x85"]
    file = Tokenizer.from_file(FILE)
    file.encode_special_tokens = True
    ours, theirs = byte_bpe.encoder(RANKS, P.PATTERN), byte_bpe.encoder(FILE, P.PATTERN)
    for _ in range(3000):
        text = "".join(random.choices(parts, k=random.randint(0, 14)))
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == known.encode_ordinary(text), text
        assert np.frombuffer(theirs.encode(text), "<u4").tolist() == file.encode(text, add_special_tokens=False).ids, text


def test_encode_and_decode_round_trip(spark, known):
    docs = frame(spark, ODD)
    encoded = byte_bpe.encode(docs, RANKS, P.PATTERN, offsets=True)
    assert encoded.columns == ["doc_id", "lang", "part", "ids", "starts", "ends"]
    decoded = byte_bpe.decode(encoded, RANKS, text_col="again").collect()
    for row in decoded:
        text = ODD[row.doc_id] or ""
        assert row.ids == known.encode_ordinary(text) and row.again == text and bytes(row.bytes) == text.encode()
        assert all(0 <= s < e <= len(text) for s, e in zip(row.starts, row.ends))
        assert not row.ids or (row.starts[0] == 0 and row.ends[-1] == len(text))


def test_decode_defines_odd_ids(spark):
    rows = spark.createDataFrame([(1, [100, None]), (2, None), (3, [10**6]), (4, [])], "doc_id long, ids array<int>")
    found = {r.doc_id: bytes(r.bytes) for r in byte_bpe.decode(rows, RANKS).collect()}
    assert found[2] == found[4] == b"" and found[3] == "�".encode() and found[1]


def test_packing_is_gapless_and_complete(spark):
    docs = frame(spark, ODD + ["some words of a text " * n for n in range(1, 200, 7)]).unionAll(frame(spark, ["a"]))
    file = Tokenizer.from_file(FILE)
    file.encode_special_tokens = True
    texts = {r.doc_id: r.text or "" for r in docs.where("doc_id > 0").collect()}
    rows = packing.pack(docs, FILE, P.PATTERN, 256).collect()
    by, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert len(by[0]) == 2  # one row of id 0 each
    for doc_id, text in texts.items():
        ids, at = file.encode(text, add_special_tokens=False).ids + [0], 0
        for k, p in enumerate(sorted(by[doc_id], key=lambda p: p.piece)):
            assert (p.piece, p.start) == (k, at) and (k == 0 or p.length == 256)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 256
    total = sum(r.length for r in rows)
    assert len(sequences) <= -(-total // 256) + 1
    assert packing.pack(docs.where("doc_id > 9999"), FILE, P.PATTERN, 256).count() == 0


def test_packing_query_keeps_ids_of_added_tokens(spark, tmp_path):
    import corpus_pipeline
    from pricebase.llm import registry

    texts = ["a<|endoftext|>b", "<|endoftext|>", "a  <|endoftext|> <|endoftext|>\n" * 700, "<|endoftext|", "plain 日本", None]
    docs = frame(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    file = Tokenizer.from_file(FILE)
    assert file.encode(texts[0], add_special_tokens=False).ids == [64, 50256, 65]
    for packed in (registry.op3_packing(spark, str(tmp_path)), corpus_pipeline.best_fit_packing(spark, docs, str(tmp_path))):
        rows = packed.collect()
        for doc_id, text in enumerate(texts):
            ids = file.encode(text or "", add_special_tokens=False).ids + [0]
            own = sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.piece)
            assert [(r.start, r.length) for r in own] == packing.cut(len(ids), 2048)
            assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in own)


def test_fillings_use_every_piece_once():
    random.seed(2)
    for size, most in ((1, 4), (40, 3), (300, 60)):
        histogram = {random.randint(1, 512): random.randint(1, most) for _ in range(size)}
        plan = packing.fillings(histogram, 512)
        used = Counter()
        for filling, times in plan:
            assert sum(k * n for k, n in filling.items()) <= 512
            used.update({k: n * times for k, n in filling.items()})
        assert used == Counter(histogram)
        lengths = np.array(sorted(histogram))
        plain = packing.best_fit(lengths, np.array([histogram[k] for k in lengths.tolist()]), 512)
        assert sum(t for _, t in plan) <= sum(plain.values()) + 1


def test_the_program_packs_what_best_fit_cannot():
    rng, histogram = np.random.default_rng(1), Counter()
    while len(histogram) < 90:  # triples that fill a sequence exactly: as many sequences as triples, and no fewer
        a, b = (int(x) for x in rng.integers(129, 256, 2))
        if 128 < 512 - a - b < 256:
            histogram.update({k: 20 * n for k, n in Counter([a, b, 512 - a - b]).items()})
    lengths = np.array(sorted(histogram))
    counts = np.array([histogram[k] for k in lengths.tolist()])
    optimum = sum(counts) // 3
    cover, value, bound = packing.Program(lengths, counts, 512).cover(packing.ROUNDS)
    assert optimum - 1e-6 <= bound + 1e-3 and optimum <= value + 1e-6 and value <= 1.03 * optimum
    made, rest = packing.solved(lengths, counts, 512)
    assert made.total() >= 0.95 * optimum and rest.total() <= 0.05 * optimum
    assert sum(t for _, t in packing.fillings(dict(histogram), 512)) <= 1.01 * optimum
    assert sum(packing.best_fit(lengths, counts, 512).values()) > 1.05 * optimum


PAGE = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body class="no-sidebar"><nav><ul><li>menu</ul></nav>
<div class="ad-box ad">buy</div><article><h1>One &amp; two</h1><p><b>First<br><p>Second  line
</p><div class="share">tweet</div></article><div id="comments"><p>nice</p></div><footer>f</footer></body></html>"""


def test_main_text_of_a_page():
    assert html_text.main_text(PAGE, frozenset()) == "One & two\n\nFirst\n\nSecond line"
    assert html_text.main_text("", frozenset()) == ""
    assert html_text.main_text("a < b <i>c</i> &lt;<p>x<ul><li>1<li>2</ul>", frozenset()) == "a < b c <\n\nx\n\n1\n\n2"
    assert html_text.main_text("<div>" * 3000 + "deep", frozenset()) == "deep"


def test_names_never_cost_an_article_its_text():
    def text(html, template=frozenset()):
        return html_text.main_text(html, template)

    assert text('<article class="post comment-open"><h1>T</h1><p>body</p></article><div class=menu>m</div>') == "T\n\nbody"
    assert text('<article class="comment"><p>alone</p></article>') == "alone"
    inner = '<h2 id="social-history">H</h2><section id="related-work"><p>r</p></section><p class="notice">n</p><div class="share">s</div>'
    assert text(f"<article>{inner}<div class=comments><p>c</p></div></article>") == "H\n\nr\n\nn"
    assert text("<main><h1>Title</h1><article><p>x</p></article><aside>a</aside></main>") == "Title\n\nx"
    assert text('<article><p>x</p><article class="comment"><p>c</p></article></article>') == "x"
    assert text("<main><p>x</p></main><article class=comment><p>c</p></article>") == "x"
    # parts of names tell furniture only where the host cannot be counted, and only outside articles
    page = '<div class="site-menu">m</div><div><p>x</p></div>'
    assert text(page, None) == "x" and text(page) == "m\n\nx"


def test_deep_and_broken_pages_take_linear_time():
    start = time.perf_counter()
    assert html_text.main_text("<div>" * 20_000 + "deep", None) == "deep"
    assert html_text.main_text("<b><div>" + "<i>" * 20_000 + "x" + "</b>" * 20_000, None) == "x"
    assert html_text.main_text("a < " * 20_000 + "<p>b", None).endswith("<\n\nb")
    assert time.perf_counter() - start < 5


def test_templates_without_telling_names(spark, monkeypatch):
    """Menus, teasers and imprints of plain elements go because they recur; both ways of the join agree."""
    page = "<body><div><div><span>Start</span></div><div>About {h}</div></div><div><p>story {i} of {h}</p><p>more {i}</p></div><div>Imprint {h}</div></body>"
    pages = [(100 * h + i, f"https://h{h}.org/{i}", page.format(h=h, i=i)) for h in range(3) for i in range(4)]
    pages += [(900 + i, "https://few.org/", page.format(h=9, i=i)) for i in range(2)]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in html_text.extract(rows).collect()}
    for h in range(3):
        for i in range(4):
            assert found[100 * h + i] == f"story {i} of {h}\n\nmore {i}"
    assert found[900] == "Start\n\nAbout 9\n\nstory 0 of 9\n\nmore 0\n\nImprint 9"
    monkeypatch.setattr(html_text, "TEMPLATES_SENT", 0)
    assert {r.page_id: r.text for r in html_text.extract(rows).collect()} == found


def test_template_goes_and_articles_stay(spark):
    pages = [(i, f"http://h.org/{i}", f"<body><div><span>site line</span></div><p>own {i}</p></body>") for i in range(6)]
    pages += [(10 + i, "http://same.org/", "<article><p>the same</p></article>") for i in range(4)]
    pages += [(20, None, None), (21, "x", ""), (22, "http://one.org", "<div>site line</div>")]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    found = {r.page_id: r for r in html_text.extract(rows).collect()}
    assert all(found[i].text == f"own {i}" for i in range(6)) and all(found[10 + i].text == "the same" for i in range(4))
    assert found[20].text == "" and found[21].n_chars == 0 and found[22].text == "site line"
    assert html_text.extract(rows.where("page_id > 99")).count() == 0


def test_recurring_article_text_stays(spark):
    real = spark.read.parquet(f"{SMALL}/pages.parquet").first().html
    near = [real + f"<p>{i}</p>" for i in range(3)]
    pages = [(i, "http://copies.org/", real) for i in range(3)] + [(10 + i, "http://near.org/", h) for i, h in enumerate(near)]
    body = "<article><div class=body><p>the text</p><ul><li>one</ul></div><p>n {}</article>"
    pages += [(20 + i, "http://wrap.org/", body.format(i)) for i in range(4)]
    pages += [(30 + i, "http://inline.org/", f"<p>do <em>not</em> go {i}</p>") for i in range(4)]
    pages += [(40 + i, "http://same.org/", "<div>only line</div>") for i in range(4)]
    found = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(found[i] == found[10 + i] == html_text.main_text(real, frozenset()) for i in range(3))
    assert all(found[20 + i] == f"the text\n\none\n\nn {i}" and found[30 + i] == f"do not go {i}" for i in range(4))
    assert all(found[40 + i] == "only line" for i in range(4))


def test_extraction_of_the_test_pages(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    from html import unescape

    for row in html_text.extract(pages).collect():
        body = re.search(r"<article>(.*)</article>", html[row.page_id], re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<br>|</?b>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert row.text == "\n\n".join(b for b in blocks if b) and row.n_chars == len(row.text)


def test_quality_is_learned_without_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    trees = quality.train(docs, labels)
    scored = quality.score(docs, trees).join(labels, "doc_id").where(quality.held_out()).select("score", "predicted", "quality").collect()
    assert sum(r.predicted == r.quality for r in scored) >= 0.9 * len(scored)
    assert all(0 <= r.score <= 1 for r in scored)
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.train(docs, flipped)
    assert np.array_equal(trees.value, again.value) and np.array_equal(trees.threshold, again.threshold)
    assert quality.remainder(12) == zlib.crc32(b"12") % 5


def test_quality_of_odd_input(spark):
    docs = frame(spark, ODD).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 0, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")
    trees = quality.train(docs, labels)
    assert quality.score(docs, trees).count() == len(ODD)
    assert quality.good_documents(docs, trees).columns == docs.columns
    assert quality.score(docs.limit(0), quality.train(docs, labels.limit(0))).count() == 0


def test_trees_traverse_as_written():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(800, 5))
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] > 0)).astype(float)
    trees = quality.fit(x, y)

    def slow(row):
        total = trees.base
        for at in trees.roots:
            while trees.left[at] != at:
                at = trees.left[at] if row[trees.feature[at]] <= trees.threshold[at] else trees.right[at]
            total += trees.value[at]
        return 1 / (1 + np.exp(-total))

    scores = trees.score(x)
    assert np.allclose(scores, [slow(r) for r in x]) and ((scores > 0.5) == (y > 0)).mean() > 0.95


def test_patience_alignment_against_lcs():
    random.seed(4)
    for _ in range(300):
        a, b = ([random.choice(b"abcdefghij") for _ in range(random.randint(0, 14))] for _ in range(2))
        pairs = license_scan.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, v in enumerate(a):
            for j, w in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if v == w else max(best[i][j + 1], best[i + 1][j])
        assert len(pairs) <= best[-1][-1]
        if len(set(a)) == len(a) and len(set(b)) == len(b):
            assert len(pairs) == best[-1][-1]


def test_licenses_are_found_whole_changed_and_repeated(spark):
    mit = next(t for n, t in license_scan.TEMPLATES if n == "MIT" and len(t) > 200)
    changed = mit.replace("merge, ", "").replace("free of charge", "for no charge at all")
    texts = [
        None, "", "no notice here", f"x y {mit} z", f"{changed}", "Released under the MIT License.\n" * 50,
        "word " * 4000 + "Licensed under CC BY-NC 4.0.", "released the MIT thing under no licence", "license " * 2000,
    ]
    found = {r.doc_id: r.notices for r in license_scan.scan_licenses(frame(spark, texts)).collect()}
    assert [len(found[i]) for i in range(9)] == [0, 0, 0, 1, 1, 50, 1, 0, 0]
    assert found[3][0].license == found[4][0].license == "MIT" and found[3][0].coverage == 1.0 and 0.8 <= found[4][0].coverage < 1
    assert (found[6][0].license, found[6][0].first_word) == ("CC-BY-NC-4.0", 4000)
    assert found[3][0].first_word == 2


def test_other_licenses_are_not_taken_for_known_ones():
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    work = "This work is licensed under "
    expected = {
        "Released under the Apache License": [],
        "This project is licensed under the terms of the BSD license.": [],
        work + "the GNU General Public License, version 2.": ["GPL-2.0"],
        work + "the GNU General Public License, version 3.": ["GPL-3.0"],
        work + "the GNU Lesser General Public License, version 3.": ["LGPL-3.0"],
        work + "the GNU Affero General Public License, version 3.": ["AGPL-3.0"],
        work + "the GNU Library General Public License, version 2.": [],
        work + "the GNU General Public License, version 3 or any later version.": [],
        "Licensed under CC BY 4.0.": ["CC-BY-4.0"],
        "Licensed under CC BY-SA 4.0.": ["CC-BY-SA-4.0"],
        "Licensed under CC BY-ND 4.0.": [],
        work + "a Creative Commons Attribution-ShareAlike 4.0 International License.": ["CC-BY-SA-4.0"],
        work + "a Creative Commons Attribution 3.0 International License.": [],
    } | {text: [name] for name, text in license_scan.TEMPLATES}
    bsd3 = next(t for n, t in license_scan.TEMPLATES if n == "BSD-3-Clause")
    expected[bsd3.replace("copyright holder", "University of X").replace("specific prior", "")] = ["BSD-3-Clause"]
    for text, names in expected.items():
        assert [f.license for f in scanner.scan(f"a b {text} c d")] == names, text


def test_licenses_of_the_test_documents(spark):
    docs = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet")
    lines = [t for _, t in license_scan.TEMPLATES if len(t) < 80]
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    for row in license_scan.scan_licenses(docs).collect():
        assert len(row.notices) == sum(text[row.doc_id].count(line) for line in lines)


def test_hash_of_bytes_table():
    table = byte_bpe.byte_characters()
    assert len(set(table.values())) == 256 and byte_bpe.as_bytes(byte_bpe.as_characters(bytes(range(256)))) == bytes(range(256))
    assert hashlib.sha256(byte_bpe.as_bytes("Ġ")).digest() == hashlib.sha256(b" ").digest()


def test_workers_forget_what_packing_remembered(spark):
    """Workers serve later stages too: only the tokenizer stays in them."""
    import pyarrow as pa

    docs = frame(spark, [f"some words {chr(97 + n % 26) * 3} and {chr(97 + n // 26) * 4}, others" for n in range(400)]).repartition(4)
    assert packing.pack(docs, FILE, P.PATTERN, 256, added_tokens=True).count() == 400

    def held(batches):
        own = byte_bpe.encoder(FILE, P.PATTERN, True)._own
        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([sum(len(d) + len(d._older) for d in (own._pieces, own._chunks))], pa.int64())], ["n"])

    assert [r.n for r in spark.range(0, 4, 1, 4).mapInArrow(held, "n long").collect()] == [0] * 4


def test_encoder_gives_the_same_ids_after_forgetting(monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 7)
    texts = ["words that come again, and again " * 3, "é" * 30 + " <|endoftext|> x", "other words, others. " * 5]
    own = byte_bpe.encoder(FILE, P.PATTERN, True)
    first = [own.encode(t) for t in texts]
    assert all(len(d) <= 7 and len(d._older) <= 7 for d in (own._own._pieces, own._own._chunks))
    own.forget()
    assert not own._own._pieces and not own._own._chunks._older
    assert [own.encode(t) for t in texts] == first
    own.forget()
