"""Prefix trie, alignment of tokenizers and quality rules against brute-force versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pricebase.llm import prefix_trie, quality_rules, registry, token_alignment
from tests.conftest import SMALL

CONVERSATIONS = "conv_id long, turn long, role string, text string, path string, node int"


def conversation_rows():
    random.seed(3)
    rows = []
    for c in [*range(0, 40), 100, 101, 150, 203, 299, 100_007]:
        n = random.choice([0, 1, 2, 3, 5, 9])
        rows += [(c, t, random.choice(["user", "assistant"]), random.choice(["a", "bé😀", "x" * 50, None, ""])) for t in range(n)]
    for c in range(500, 540):  # copies, and one that goes on
        rows += [(c, t, "user", f"same {t}") for t in range(3)] + ([(c, 9, "assistant", "more")] if c % 7 == 0 else [])
    rows += [(600, None, "user", "unnumbered"), (600, None, None, None), (600, 1, "user", "one"), (600, 1, "user", "one"), (600, 1, "user", "tied")]
    rows += [(700, t, "user", f"deep {t % 3}") for t in range(300)] + [(-5, 0, "user", "negative"), (None, 0, "user", "nobody's")]
    random.shuffle(rows)
    return rows


def brute_trie(paths):
    """paths: conv_id -> list of (role, text)."""
    members = defaultdict(list)
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    found = []
    for p, convs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(convs) if len(paths[c]) == len(p))
        found.append((
            min(convs), len(p), min(members[p[:-1]]) if p else None, len(convs), children[p], sum(not children[q] for q in below),
            sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return Counter(found)


def ordered(rows):
    def digest(role, text):
        return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()

    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((t is not None, t or 0, digest(role, text), role, text))
    return {c: [x[3:] for x in sorted(own)] for c, own in turns.items()}


def nodes_of(frame):
    return Counter(
        (r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in frame.collect()
    )


@pytest.mark.parametrize("block", [20_000, 3])
def test_trie_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rows = conversation_rows()
    frame = spark.createDataFrame([(*r, "extra", 1) for r in rows], CONVERSATIONS)
    own = ordered(rows)
    lists = prefix_trie.turn_lists(frame)
    nodes = prefix_trie.trie(lists).cache()
    assert nodes_of(nodes) == brute_trie(own)
    for r in prefix_trie.node_texts(nodes, frame).collect():
        assert (r.role, r.text) == (own[r.conv_id][r.depth - 1] if r.depth else (None, None))
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = own.get(int(c / 100) * 100, [])[:h] + turns[h:]
    assert nodes_of(prefix_trie.trie(prefix_trie.with_shared_opening(lists))) == brute_trie(rebuilt)


def test_trie_without_conversations(spark):
    empty = spark.createDataFrame([], CONVERSATIONS)
    assert prefix_trie.trie(prefix_trie.with_shared_opening(prefix_trie.turn_lists(empty))).count() == 0


def test_trie_against_its_sql(spark):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SMALL}/conversations.parquet'")
    wanted = connection.execute(
        f"SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM ({registry.SQL['op11_prefix_trie']})"
    ).fetchall()
    assert nodes_of(registry.QUERIES["op11_prefix_trie"](spark, SMALL)) == Counter(wanted)


TEXTS = [
    None, "", " ", "plain words in a row", "Unüblich schön: naïve café, 東京タワー", "emoji 👩‍👩‍👧 and flags 🇫🇷", "tab\there\nand  two  spaces ",
    "a <|endoftext|> b <s> </s> <unk> <0x41>", "▁ lower block ▁▁", "x" * 3000, "nul \x00 byte", "wide　space hard", "plain words in a row",
    "\n\nlines\n\n", "ﬁne ligature ½", "1234567890 12,345.67", "the the the the",
]
PATHS = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))


def brute_alignment(rows):
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[2])
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    back = {chr(x): x for x in printable} | {chr(0x100 + i): x for i, x in enumerate(x for x in range(256) if x not in printable)}

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    docs, counts = [], Counter()
    for i, text in rows:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        parts_a, parts_b = [bytes(back[c] for c in a.id_to_token(x)) for x in ids_a], [piece(x) for x in ids_b]
        if not text or not b"".join(parts_a) == b"".join(parts_b) == b" " + text.encode():
            ids_a = ids_b = parts_a = parts_b = []
        ends_a, ends_b = (np.cumsum([len(p) for p in parts]).tolist() for parts in (parts_a, parts_b))
        links = [(x, y) for e, x in zip(ends_a, ids_a) for f, y in zip(ends_b, ids_b) if e == f]
        counts.update(links)
        cuts = [0, *sorted(set(ends_a) & set(ends_b))]
        inside = lambda ids, ends, s, e: ",".join(str(x) for x, at in zip(ids, ends) if s < at <= e)
        groups = ";".join(inside(ids_a, ends_a, s, e) + "|" + inside(ids_b, ends_b, s, e) for s, e in zip(cuts, cuts[1:]))
        docs.append((i, ids_a, ids_b, len(cuts) - 1, links, groups))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return counts, Counter(
        (i, len(x), len(y), n, len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), groups)
        for i, x, y, n, links, groups in docs
    )


@pytest.mark.parametrize("room", [256 << 20, 200])
def test_alignment_against_brute_force(spark, monkeypatch, room):
    monkeypatch.setattr(token_alignment, "MOST_BYTES", room)  # also with several passes over the kept ids
    rows = list(enumerate(TEXTS)) + [(None, "null id"), (3, "plain words in a row"), (3, "other text of this id")]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_a int, pairs string")
    counts, wanted = brute_alignment(rows)
    found = token_alignment.aligned(frame, *PATHS).collect()
    assert Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in found) == wanted
    assert sum(r.n_links > 0 for r in found) >= 12
    assert token_alignment.aligned(frame.limit(0), *PATHS).count() == 0
    if room > 1000:
        assert {(r.id_a, r.id_b): r["count"] for r in token_alignment.pair_counts(frame, *PATHS).collect()} == counts


def test_alignment_query_on_the_small_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    _, wanted = brute_alignment([(r.doc_id, r.text) for r in docs])
    wanted = Counter((*w[:-1], hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "") for w in wanted.elements())
    found = registry.QUERIES["op12_token_alignment"](spark, SMALL).collect()
    assert Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in found) == wanted


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 64, 5000):
        keys = np.unique(rng.integers(0, 1 << 31, n))
        own = token_alignment.PerfectHash.of(keys)
        assert sorted(own(keys).tolist()) == list(range(len(keys)))


def slow_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    seen, duplicates = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            duplicates += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), duplicates, len(inside)


def test_base_rules_against_brute_force(spark):
    random.seed(5)
    texts = TEXTS + ["a b c " * 60, "l1\nl1\n \n \nl2\nl1 \nl1", "a a a a", "a b c d a b c", "é è\u0085x \x1c y \x0b z", "# * $ % & | < > @"]
    texts += [" ".join(random.choice("abcdefgh") for _ in range(random.randrange(200))) for _ in range(60)]
    rows = [(i, t, 5, "n") for i, t in enumerate(texts)] + [(None, "x", 1, None), (4, "x", 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int, margin string")
    model = quality_rules.Model(np.zeros(quality_rules.BUCKETS), 0.0, 1.0, 3.0)
    found = quality_rules.judge(docs, model).collect()
    wanted = Counter()
    for i, t, _, margin in rows:
        c = slow_counts(t)
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        wanted[(i, *c, failed, not failed, margin)] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r.margin) for r in found) == wanted
    assert not any(r.kept for r in quality_rules.judge(docs, quality_rules.Model(model.weights, 0.0, 1.0, -3.0)).collect())


def test_margin_equals_the_sparse_product():
    rng = np.random.default_rng(2)
    model = quality_rules.Model(rng.normal(size=quality_rules.BUCKETS), 0.25, 1.0, 0.0)
    for text in ["", "a", "ab cd ef ab cd", "wörter und wörter " * 30]:
        grams = quality_rules.read(text).grams()
        buckets, values = quality_rules.shares(grams)
        assert abs(model.margin(grams) - 0.25 - float(model.weights[buckets.astype(int)] @ values)) < 1e-4


def test_quality_rules_on_held_out_labels(spark):
    folder = SMALL.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_rules.train(docs, labels)
    held = docs.join(labels, "doc_id").where(quality_rules.fold() == quality_rules.HELD_OUT)
    rows = quality_rules.judge(held, model).select("quality", "base_failed", "probability", "kept").collect()
    good, bad = ([r for r in rows if r.quality == q and not r.base_failed] for q in (1, 0))
    assert len(good) > 400 and len(bad) > 30
    assert sum(r.kept for r in good) >= 0.98 * len(good) and sum(r.kept for r in bad) <= 0.05 * len(bad)
    # probabilities mean what they say
    assert abs(np.mean([r.probability for r in rows]) - np.mean([r.quality for r in rows])) < 0.05


def test_quality_rules_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (9, 1), (None, 0)], "doc_id long, quality int")
    model = quality_rules.train(docs, labels)
    assert {r.probability for r in quality_rules.judge(docs, model).collect()} == {0.5}
    assert quality_rules.judge(docs.limit(0), model).count() == 0
