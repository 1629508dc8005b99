"""Rules, duplicates, fingerprints, shards and joins against brute force; nulls, ties, repeated and hot rows."""

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from checks.compare import connect, difference, normal
from pricebase.llm import exact_dedup, ngram_join, order_minhash, registry, sharding, url_filter
from pricebase.session import ensure_checkpoint_dir
from tests.conftest import SMALL


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("clash")).withColumn("run", F.lit(0))


def mixture(seed=1):
    """A hot group, near copies, empty and null texts, repeated rows, a long text."""
    random.seed(seed)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(random.choices(words, k=random.randint(1, 60))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100 + i, "the same text in very many rows of this table") for i in range(60)]
    base = random.choices(words, k=80)
    for i in range(25):
        own = base[:]
        own[random.randrange(80)] = f"changed{i}"
        rows.append((200 + i, " ".join(own)))
    common = " ".join(random.choices(words, k=30))
    rows += [(300 + i, common + " " + " ".join(random.choices(words, k=20))) for i in range(25)]
    rows += [(400, None), (401, ""), (402, " \n\t"), (403, "one two"), (404, "ONE two"), (405, "x " * 30_000), (5, texts[5]), (406, "ünï " * 7)]
    return rows


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, name):
    found = registry.QUERIES[name](spark, SMALL)
    mine = normal(found.columns, [tuple(r) for r in found.collect()])
    cursor = connect(SMALL).execute(registry.SQL[name])
    assert difference(mine, normal([d[0] for d in cursor.description], cursor.fetchall())) == ""


def test_rules_against_brute_force(spark):
    random.seed(3)
    hosts = ["org", "example.org", "a.example.org", "b.a.example.org", "com", "x.com", "myexample.org", ""]
    paths = ["", "/", "/e", "/en", "/en/1", "/en/12", "/es/", "/\U0010ffffz"]
    rules = list({(random.choice(hosts[:-1]), random.choice(paths), random.choice(["allow", "block"])) for _ in range(40)})
    urls = [(i, f"http://{random.choice(hosts)}{random.choice(paths)}{random.choice(['', '2', '/x', '?q=/', '#f'])}") for i in range(400)]
    urls += [(900, None), (901, "no scheme/en"), (902, "HTTP://EXAMPLE.org"), (902, "HTTP://EXAMPLE.org"), (None, "http://x.com/en")]
    urls += [(1000 + i, "http://b.a.example.org/en/1") for i in range(200)]
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumn("host", F.lit("clash"))
    found = url_filter.judge_urls(pages, spark.createDataFrame([*rules, (None, "/", "block")], "host string, path string, verdict string")).collect()
    merged = {}
    for h, p, v in rules:
        merged[h, p] = max(v, merged.get((h, p), ""))

    def judged(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
        host, tail = rest[:cut].lower(), rest[cut:]
        path = tail[: min([i for i in map(tail.find, "?#") if i >= 0], default=len(tail))]
        fits = [(len(h + p), len(h), h + p, v) for (h, p), v in merged.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, "allow"))
        return host, path, best[2], best[3]

    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in found) == Counter((i, *judged(u)) for i, u in urls)
    assert url_filter.judge_urls(pages.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0
    assert url_filter.judge_urls(pages, spark.createDataFrame([], "host string, path string, verdict string")).where("rule is null").count() == len(urls)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_duplicates_against_brute_force(spark, keep):
    rows = mixture() + [(None, "one two"), (None, "alone"), (7, "one two")]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    best = {t: (min if keep == "smallest" else max)((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    found = exact_dedup.exact_duplicates(docs_of(spark, rows), keep=keep).collect()
    sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    assert Counter((r.doc_id, r.text_sha256) for r in found) == Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    for r in found:
        t = sha[r.text_sha256]
        assert (r.keep_id, r.group_size) == (best[t], len(groups[t]))
    kept = Counter(r.text_sha256 for r in found if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r.doc_id == r.keep_id for r in found if r.kept)
    assert exact_dedup.exact_duplicates(docs_of(spark, rows).limit(0)).count() == 0


def test_rows_without_duplicates(spark):
    docs = docs_of(spark, mixture())
    left = exact_dedup.without_duplicates(docs, "largest")
    assert left.columns == docs.columns and left.count() == len({t or "" for _, t in mixture()})


def test_groups_over_many_ranges(spark):
    rows = [(i, "hot") for i in range(400)] + [(1000 + i, f"t{i}") for i in range(40)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        found = exact_dedup.exact_duplicates(docs_of(spark, rows), keep="largest").where("doc_id < 1000").collect()
        assert {(r.keep_id, r.group_size) for r in found} == {(399, 400)} and sum(r.kept for r in found) == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("partitions", ["2", "8", "64"])
def test_divided_groups_among_texts_with_their_beginning(spark, partitions):
    """Hot texts that share their first characters with each other and with many single texts."""
    opening = "the very same opening of all these texts, longer than a splitter's: "
    rows = [(i, opening + "hot") for i in range(1500)] + [(5000 + i, opening + "second") for i in range(700)]
    rows += [(10000 + i, f"{opening}{i * 7919 % 1500}") for i in range(1500)] + [(20000 + i, opening) for i in range(300)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        for keep, best in (("largest", max), ("smallest", min)):
            found = exact_dedup.exact_duplicates(docs_of(spark, rows), keep=keep).collect()
            groups = defaultdict(list)
            for i, t in rows:
                groups[t].append(i)
            text = dict(rows)
            assert len(found) == len(rows) and sum(r.kept for r in found) == len(groups)
            for r in found:
                own = groups[text[r.doc_id]]
                assert (r.keep_id, r.group_size, r.kept) == (best(own), len(own), r.doc_id == best(own))
        assert exact_dedup.without_duplicates(docs_of(spark, rows)).count() == len(groups)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_shards_are_even_and_gapless(spark):
    rows = mixture() + [(2000 + i, f"text number {i} " * (1 + i % 9)) for i in range(2000)] + [(None, "null id")]
    rows += [(9000 + i, "a hot text of some length") for i in range(900)]
    found = sharding.shards(docs_of(spark, [r for r in rows if r[0] != 405]), 8).collect()
    assert len(found) == len(rows) - 1 and {r.law for r in found} == {"bytes"}
    sizes, slots = Counter(), defaultdict(list)
    for r in found:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(sizes) == set(range(8)) and max(sizes.values()) <= 1.05 * min(sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    text = {i: t or "" for i, t in rows}
    for r in found:
        if r.doc_id is not None:
            assert (r.size, r.text_crc32) == (len(text[r.doc_id].encode()) + 1, zlib.crc32(text[r.doc_id].encode()))
    assert sharding.shards(docs_of(spark, rows).limit(0)).count() == 0


def test_texts_without_repeated_rows_are_aggregated_nowhere(spark):
    rows = [(i, f"text {i % 7}") for i in range(40)] + [(None, "text 3"), (None, "alone"), (50, None), (51, "")]
    docs = docs_of(spark, rows).withColumn("other", F.lit("o"))
    left = exact_dedup.without_duplicates(docs, keep="largest")
    assert "first(text" not in left._jdf.queryExecution().optimizedPlan().toString()
    best = {}
    for i, t in rows:
        best[t or ""] = max(best.get(t or "", -1), -1 if i is None else i)
    assert Counter((r.text or "", -1 if r.doc_id is None else r.doc_id) for r in left.collect()) == Counter(best.items())
    twice = docs.union(docs.where("doc_id > 30 or doc_id is null"))
    left = exact_dedup.without_duplicates(twice, keep="largest")
    assert left.columns == docs.columns
    assert Counter((r.text or "", -1 if r.doc_id is None else r.doc_id) for r in left.collect()) == Counter(best.items())


def brute_components(rows):
    sets = {}
    for i, t in rows:
        words = (t or "").encode().lower().split()
        grams = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}
        sets[i] = grams
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def chains(seed):
    """Texts that differ step by step, so that links form chains of borderline pairs."""
    random.seed(seed)
    rows, own = [], [f"v{i}" for i in range(60)]
    for i in range(60):
        own = own[:]
        for _ in range(random.choice([1, 1, 2])):
            own[random.randrange(len(own))] = f"n{seed}-{i}"
        if random.random() < 0.3:
            own.append(f"longer{i}")
        rows.append((1000 * seed + i, " ".join(own)))
    return rows


@pytest.mark.parametrize("frequent", [4, 1])
def test_components_against_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "SAMPLE_ONE_IN", 1)  # so that common n-grams count as frequent
    rows = mixture() + [r for seed in (2, 3, 4) for r in chains(seed)]
    found = ngram_join.ngram_components(docs_of(spark, rows)).collect()
    wanted = brute_components(rows)
    assert Counter(r.doc_id for r in found) == Counter(i for i, _ in rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == wanted


def test_large_group_of_borderline_copies(spark, monkeypatch):
    """Copies of one text of which about half of all pairs are similar, and others that reach few of them."""
    monkeypatch.setattr(ngram_join, "MET_AT_ONCE", 2)
    random.seed(11)
    base, rows = [f"w{i}" for i in range(90)], []
    for i in range(160):
        own = base[:]
        for _ in range(random.choice([1, 2, 2, 3, 3, 4])):
            own[random.randrange(len(own))] = f"edit{i}-{random.random()}"
        rows.append((i, " ".join(own)))
    found = ngram_join.ngram_components(docs_of(spark, rows)).collect()
    wanted = brute_components(rows)
    assert 1 < len({c for _, c in wanted.values()}) < 150
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == wanted


def test_parities_bound_the_difference():
    import numpy as np

    rng = np.random.default_rng(3)
    for size in (1, 50, 400, 5000):
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64)) << np.uint64(1)
        for changed in (0, 1, size // 7, size):
            b = np.unique(np.concatenate([a[changed:], rng.integers(0, 1 << 63, changed, dtype=np.uint64)]))
            turned = int(np.bitwise_count((ngram_join.parities(a) ^ ngram_join.parities(b)).view(np.uint64)).sum())
            assert turned <= len(np.setxor1d(a, b))


def half_alike(pairs=30):
    """Pairs of texts that share half of their words."""
    random.seed(23)
    rows = []
    for i in range(pairs):
        common, own = ([f"{k}{i}-{j}" for j in range(120)] for k in "cd")
        rows += [(2 * i, " ".join(common + own)), (2 * i + 1, " ".join(common + own[::-1]))]
    return rows


def test_texts_of_pairs_that_sizes_and_parities_rule_out_are_not_moved(spark, monkeypatch):
    compared, links = [], ngram_join._links

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return links(pairs, *rest)

    monkeypatch.setattr(ngram_join, "_links", counted)
    rows = half_alike()
    found = ngram_join.ngram_components(docs_of(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(rows)
    assert sum(compared) < 10  # of 30 pairs that share signatures


def test_dealt_signatures_are_small(spark):
    import numpy as np

    docs = docs_of(spark, half_alike()).coalesce(1)
    dealt = ngram_join._sign(docs, np.zeros(1 << ngram_join.BITS, bool), 5, ngram_join.SIMILARITY, 16).where("kind < 2").collect()
    sets = ngram_join.ngram_sets([t for _, t in half_alike()])
    signed = sum(len(ngram_join.signatures(s, np.zeros(len(s), bool), ngram_join.Bands())) for s in sets)
    assert sum(len(v) for r in dealt for v in (r.a, r.b, r.c, r.d)) < 8 * signed


def test_packed_numbers_come_back():
    import numpy as np

    rng = np.random.default_rng(4)
    for least, most in ((0, 3), (-(2**63), 2**63 - 1), (70_000, 80_000)):
        ids = rng.integers(least, most, 500)
        assert (ngram_join._unpacked_ids(ngram_join._packed_ids(ids)) == ids).all()
        ids = np.sort(np.repeat(ids, rng.integers(1, 400, 500)))
        assert (ngram_join._unpacked(*ngram_join._packed(ids)) == ids).all()


def test_components_of_odd_input(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, ""), (4, "A b C d e f")]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs_of(spark, rows)).collect()}
    assert found == {None: (2, None), 1: (2, 1), 2: (0, 2), 3: (0, 3), 4: (2, 1)}
    docs = docs_of(spark, rows)
    left = ngram_join.one_of_each(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.where("doc_id is not null").collect()) == [1, 2, 3]
    assert ngram_join.ngram_components(docs.limit(0)).count() == 0


def test_ids_with_several_texts_lose_no_link(spark):
    random.seed(5)
    one, two, three = ([f"{k}{i}" for i in range(60)] for k in "xyz")
    near = one[:-1] + ["other"]
    rows = [(5, " ".join(one)), (5, " ".join(two)), (3, " ".join(two)), (9, " ".join(near)), (12, " ".join(three)), (9, " ".join(three[:-1]))]
    rows += [(20, " ".join(three)), (30, "alone it is not like any of them")]
    found = {r.doc_id: r.component_id for r in ngram_join.ngram_components(docs_of(spark, rows)).collect()}
    assert found == {3: 3, 5: 3, 9: 3, 12: 3, 20: 3, 30: 30}
    left = ngram_join.one_of_each(docs_of(spark, rows)).collect()
    assert {r.doc_id for r in left} == {3, 30}


def test_runs_remove_their_intermediate_tables(spark):
    folder = urlparse(ensure_checkpoint_dir(spark)).path
    before = set(os.listdir(folder))
    found = ngram_join.ngram_components(docs_of(spark, mixture()))
    (left,) = set(os.listdir(folder)) - before
    assert left.startswith("components-")
    assert found.count() == len(mixture())


def test_signatures_lose_no_similar_pair():
    """Every pair at or above the similarity shares a signature, whichever elements count as frequent."""
    import numpy as np

    rng = np.random.default_rng(7)
    bands = ngram_join.Bands()
    for size in [*range(1, 40), 75, 133, 300]:
        for _ in range(25):
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            drop = rng.integers(0, max(1, len(a) // 4) + 1)
            kept = rng.permutation(a)[drop:]
            added = rng.integers(0, 1 << 63, rng.integers(0, max(1, len(a) // 3) + 1), dtype=np.uint64)
            b = np.unique(np.concatenate([kept, added]))
            if not len(b) or not ngram_join.similar(a, b):
                continue
            both = np.unique(np.concatenate([a, b]))
            for share in (0.0, 0.5, 0.95, 1.0):
                hot = set(both[rng.random(len(both)) < share].tolist())
                sa, sb = (ngram_join.signatures(s, np.array([x in hot for x in s.tolist()], bool), bands) for s in (a, b))
                assert set(sa.tolist()) & set(sb.tolist()), (size, share)




def test_fingerprints_of_edited_and_next_texts(spark):
    rows = mixture()
    found = order_minhash.edited_fingerprints(docs_of(spark, rows)).collect()
    assert Counter(r.doc_id for r in found) == Counter(i for i, _ in rows)
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (-x[0], x[1]))
    following = {i: order[(k + 1) % len(order)][1] for k, (i, _) in enumerate(order)}
    text, seen = dict(order), {}
    for r in found:
        own, n = text[r.doc_id], len(text[r.doc_id])
        edited = own[: n - n // 3] + following[r.doc_id][: n // 3]
        assert r.n_chars == n
        if r.doc_id != 5:  # repeated: its first row is followed by itself
            assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert seen.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
            if own == following[r.doc_id]:
                assert r.near_next == 1.0
        assert seen.setdefault(own, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    long = [r for r in found if r.n_chars > 200 and 200 > r.doc_id]
    assert sum(r.near_edited for r in long) > sum(r.near_next for r in long)
    assert order_minhash.edited_fingerprints(docs_of(spark, rows).limit(0)).count() == 0
    assert order_minhash.edited_fingerprints(docs_of(spark, rows[:1])).collect()[0].near_next == 1.0


def test_fingerprints_see_order(spark):
    words = [f"q{i}" for i in range(600)]
    halves = " ".join(words[300:] + words[:300])
    rows = [(1, " ".join(words)), (2, halves), (3, " ".join(words[:-1] + ["end"]))]
    prints = order_minhash.with_fingerprint(docs_of(spark, rows), "text", "sig").select("doc_id", "sig").collect()
    sig = {r.doc_id: set(r.sig) for r in prints}
    moved, edited = len(sig[1] & sig[2]), len(sig[1] & sig[3])
    assert edited >= 28 and moved < edited - 5


def test_fingerprint_selects_the_least_numbered_kmers(spark):
    """The bins and selected k-mers, recomputed in Python from Spark's own hash of every k-mer."""
    text = "a b c d e a b c d e a b c d e f g h i j k l"
    words = text.split()
    row = docs_of(spark, [(1, text)])
    hashes = row.select(F.transform(F.split("text", " "), lambda w: F.xxhash64(w)).alias("h")).first().h
    kmers = spark.createDataFrame([(i, *hashes[i : i + 5]) for i in range(len(words) - 4)], "pos int, a long, b long, c long, d long, e long")
    kmer = {r.pos: r.h for r in kmers.select("pos", F.xxhash64("a", "b", "c", "d", "e").alias("h")).collect()}
    seen, numbered = Counter(), []
    for pos in sorted(kmer):
        numbered.append((kmer[pos], seen[kmer[pos]], pos))
        seen[kmer[pos]] += 1
    g = spark.createDataFrame(numbered, "h long, o int, pos int").select("pos", F.xxhash64("h", "o").alias("g")).collect()
    bins = defaultdict(list)
    for r in g:
        bins[r.g & (order_minhash.BINS - 1)].append((r.g, r.pos))
    pairs = [(b, [v for v, _ in sorted(sorted(x)[: order_minhash.SELECTED], key=lambda y: y[1])]) for b, x in sorted(bins.items())]
    wanted = spark.createDataFrame(pairs, "bin long, own array<long>").select("bin", F.xxhash64("own").alias("h")).collect()
    mask = order_minhash.BINS - 1
    mine = order_minhash.with_fingerprint(row, "text", "sig").first().sig
    assert mine == [r.h & ~mask | r.bin for r in sorted(wanted)]


def test_rows_come_in_parts_and_memory_goes_back():
    import pyarrow as pa

    from pricebase.llm import common

    batches = [pa.record_batch({"doc_id": pa.array(range(n), pa.int64())}) for n in (0, 3, 10, 4)]
    parts = list(common.in_parts(iter(batches), 4))
    assert [p.num_rows for p in parts] == [3, 4, 4, 2, 4]
    assert [v for p in parts for v in p.column("doc_id").to_pylist()] == [v for b in batches for v in b.column("doc_id").to_pylist()]
    assert list(common.giving_back(lambda rows: (b.slice(1) for b in rows))(iter(batches[1:]))) == [b.slice(1) for b in batches[1:]]
