import random
import re

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from isospark.llm import bpe, decontam, licenses, pii, simhash, tokens, urls

from . import brute

EDGE = [None, "", " ", "\n\t ", "a", "A b", "é", "x" * 5000, "ab" * 3000, "word " * 3000, "0 1 2", "Ünïcode 中文 🎉 \x1c\x85 ok", "a b c", "A B C", "a b c"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "x", "y") for k, t in enumerate(EDGE)] + [(3, "twice the id", None, None), (None, "no id", None, None), (None, None, None, None), (3, "twice the id", None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, fp string, words string")


def test_encoder_equals_library():
    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder = bpe.Encoder(ranks, P.PATTERN)
    rng = random.Random(1)
    texts = [t for t in EDGE if t] + ["a " + chr(c) * 2 + "b " + chr(c) for c in range(0, 0x3000, 3)]
    texts += ["".join(rng.choice("ab \n\t'sé1中\x1c!.²") for _ in range(rng.randrange(60))) for _ in range(500)] + ["aab" * 9000 + "a" * 7000]
    for text, ids in zip(texts, encoder.encode_all(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)


def test_rank_order_where_a_merge_makes_a_lower_rank():
    ranks = {bytes([c]): c for c in range(256)} | {b"ba": 256, b"aba": 257, b"ab": 258, b"abab": 259, b"aa": 260}
    library = tiktoken.Encoding("own", pat_str="[ab]+", mergeable_ranks=ranks, special_tokens={})
    encoder = bpe.Encoder(ranks, "[ab]+")
    for n in range(1, 11):
        for bits in range(1 << n):
            text = "".join("ab"[bits >> k & 1] for k in range(n))
            assert encoder.encode(text) == library.encode_ordinary(text)


def test_bpe_round_trip(spark, docs):
    for r in bpe.bpe_round_trip(docs, bpe.multi_50k(spark)).collect():
        assert r.ids is not None and (r.doc_id is None or r.doc_id == 3 or bytes(r.decoded) == (EDGE[r.doc_id] or "").encode())
    codec = bpe.multi_50k(spark)
    odd = spark.createDataFrame([([97, None, 50256, -1, 10**9],), (None,), ([],)], "ids array<int>")
    assert [None if r[0] is None else len(r[0]) for r in odd.select(codec.decode(odd.ids)).collect()] == [len(next(t for t, i in codec.ranks.value.items() if i == 97)), None, 0]
    assert bpe.bpe_round_trip(docs.limit(0), codec).count() == 0


def test_perfect_codes_cover():
    rng = np.random.default_rng(0)
    codes = simhash.blocks()
    for code in codes:
        x = rng.integers(0, 1 << code.bits, 500)
        nearest = x ^ code.leader[code.syndrome(x)]
        assert not code.syndrome(nearest).any()
    assert [int(np.bitwise_count(c.leader).max()) for c in codes] == [3, 3, 1, 1]
    x = rng.integers(0, 1 << 63, 300).astype(np.int64)
    for flips in (0, 1, 2):
        y = x.copy()
        for _ in range(flips):
            y ^= np.int64(1) << rng.integers(0, 63, len(x))
        meet = [set() for _ in x]
        rows, found = simhash.anchors(x, codes)
        for r, a in zip(rows, found):
            meet[r].add(a)
        rows, found = simhash.anchors(y, codes)
        shared = np.zeros(len(x), bool)
        for r, a in zip(rows, found):
            shared[r] |= a in meet[r]
        assert shared.all()


def test_simhash_components(spark, docs):
    rows = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(docs).collect()}
    prints = {k: brute.simhash(t) for k, t in enumerate(EDGE) if k != 3}
    label = brute.components(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    for k, want in prints.items():
        signed = want - (1 << 64) if want >> 63 else want
        assert rows[(k, signed)] == label[k]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_links_through_points(spark):
    rng = random.Random(5)
    prints = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(25):
            prints.add(base)
            base ^= 1 << rng.randrange(64)
            if rng.random() < 0.4:
                base ^= 1 << rng.randrange(64)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    got = {r.node: r.component for r in simhash.components(simhash.links(df)).collect()}
    want = brute.components(signed, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    assert {n: got.get(n, n) for n in signed} == want


def test_keep_one_each(spark, docs):
    kept = simhash.keep_one_each(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert 12 in ids and 13 not in ids and 14 not in ids and ids.count(3) == 1
    assert [r.text for r in kept.where("doc_id is null").collect()] == ["no id"]


def test_points_are_dealt_to_anchors_once(spark):
    """A fingerprint's 65 points stand at its anchors, each at the one that covers it."""
    prints = np.random.default_rng(9).integers(-(1 << 63), 1 << 63, 50, dtype=np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in prints], "fp long")
    rows = simhash.anchor_points(simhash.replicate(df)).collect()
    assert len(rows) == len({(r.fp, r.point) for r in rows}) == 65 * len(set(prints))
    assert all(((r.fp ^ r.point) & (1 << 64) - 1).bit_count() <= 1 for r in rows)


def test_decontamination(spark, docs):
    long = "One two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    items = spark.createDataFrame([(1, long), (2, "a"), (3, None), (4, ""), (5, long), (None, "twice the id")], "item_id bigint, text string")
    plain = [(1, long), (2, "a"), (5, long)]
    more = spark.createDataFrame([(100, "xx " + long.lower() + " a, A!", "", ""), (101, long.replace("seven", "7"), "", ""), (102, "b " * 40 + "a", "", "")], docs.schema)
    got = {(r.doc_id, r.n_words, r.n_hit, tuple(r.items), r.contaminated) for r in decontam.find_contamination(docs.where("doc_id <> 3").union(more), items).collect()}
    texts = {k: t for k, t in enumerate(EDGE) if k != 3} | {r.doc_id: r.text for r in more.collect()}
    for k, t in texts.items():
        n, hit, found = brute.contamination(t, plain)
        assert (k, n, hit, tuple(found), hit > 0 and 20 * hit >= n) in got
    blocks = decontam.Benchmark(items, block_bytes=1)
    assert len(blocks.blocks) > 1
    small = docs.union(more).select("doc_id", blocks.scan(docs.text).alias("r")).select("doc_id", "r.*")
    assert {(r.doc_id, r.n_hit) for r in small.where("doc_id >= 100").collect()} == {(k, h) for k, _, h, _, _ in got if k >= 100}
    assert decontam.drop_contaminated(docs, items.limit(0)).count() == docs.count()
    assert decontam.drop_contaminated(docs, items).columns == docs.columns
    # Bytes that aren't UTF-8 are compared as they are, on both sides.
    raw = spark.range(1).selectExpr("1L item_id", "cast(X'61FF62' as string) text")
    other = spark.range(1).selectExpr("1L doc_id", "cast(X'784161FF62' as string) text").union(spark.range(1).selectExpr("2L", "cast(X'412061FF62' as string)"))
    assert {(r.doc_id, r.n_words, r.n_hit) for r in decontam.find_contamination(other, raw).collect()} == {(1, 1, 0), (2, 2, 1)}


def test_licenses(spark, docs):
    text = "Foo: GNU General-Public  License; mit license, MIT LICENSE cc by. Permission is hereby granted, free of any charge, to any person obtaining a copy of this software"
    more = spark.createDataFrame([(100, text, "", ""), (101, "apache, LICENSE", "", ""), (102, "apache the license", "", "")], docs.schema)
    got = {r.doc_id: r for r in licenses.scan_licenses(docs.union(more)).collect()}
    spans = [(s.label, s.base, s.start, s.stop) for s in got[100].spans if s.base]
    assert spans == [("cc-by", True, 9, 11), ("gpl", True, 1, 5), ("mit", True, 5, 7), ("mit", True, 7, 9)]
    assert [s.label for s in got[100].spans if not s.base] == ["mit"]
    assert len(got[101].spans) == 1 and got[102].spans == [] and got[0].n_words == 0 and got[1].n_words == 0
    assert licenses.scan_licenses(docs).count() == docs.count() and licenses.scan_licenses(docs.limit(0)).count() == 0
    middle = "hereby granted free of charge to any person obtaining a copy of this software and associated"
    cut = spark.createDataFrame([(1, middle), (2, f"one two {middle} three")], "doc_id long, text string")
    assert {r.doc_id: [(s.label, s.start, s.stop) for s in r.spans] for r in licenses.scan_licenses(cut).collect()} == {1: [("mit", 0, 16)], 2: [("mit", 2, 18)]}


def test_pii(spark, docs):
    texts = [
        "mail me: a.b@c.de.f, x@y, a@b.cd@e.f @ +49 (0)30 123-4567 and 10.0.0.255.1.2.3.4 256.1.1.1 001.2.3.4",
        "card 4845168114407329 4845 1681-1440 7329 4845168114407328 12345678901234567890123", "🎉 é x@y.zz +1", "1.2.3.4.5.6.7.8 +123456789 +1(2)", "a@b.c-d_e@x.y..z@q.r " * 50,
        "IBAN DE89 3704 0044 0532 0130 00, DE88 3704 0044 0532 0130 00", "ssn 123-45-6789", "plain 123-45-6789", "." * 20000 + "@a.b", "1 " * 3000,
    ]
    more = spark.createDataFrame([(100 + k, t, "", "") for k, t in enumerate(texts)], docs.schema)
    everything = docs.union(more)
    got = {r.doc_id: [(s.kind, s.start, s.stop) for s in r.spans] for r in pii.find_pii(everything).collect()}
    for k, t in enumerate(texts):
        assert [s for s in got[100 + k] if s[0] in pii.BASE] == brute.pii(t)
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    secrets = [f'x token = "{key}" y', f"commit {key}", "password: " + "a1" * 20, "key " + "x" * 30, "é ghp_16C7e42F292c6912E7710c838347Ae178B4a", "my secret keyword-" + "z" * 20, f"api_key={key[:19]}"]
    found = {r.doc_id: [(s.start, s.stop) for s in r.spans if s.kind == "secret"] for r in pii.find_pii(spark.createDataFrame(list(enumerate(secrets)), "doc_id long, text string")).collect()}
    assert found == {0: [(11, 51)], 1: [], 2: [], 3: [], 4: [(2, 42)], 5: [], 6: []}
    assert [s[0] for s in got[105]].count("iban") == 1 and ("id_number", 4, 15) in got[106] and not got[107]
    masked = {r.doc_id: r for r in pii.mask_pii(everything.withColumn("n_chars", everything.doc_id)).collect()}
    assert masked[102].text == "🎉 é [EMAIL] +1" and masked[102].n_chars == len(masked[102].text)
    assert masked[0].text is None and masked[12].text == "a b c" and masked[12].n_chars == 12
    assert pii.mask_pii(docs).columns == docs.columns


def test_url_rules(spark):
    cases = {
        "http://A.Example.org/es/x?q": "example.org/es/", "https://example.org/en/12": "example.org/en/1", "https://example.org/en/2": "org/", "http://x.com/fr/": "com/fr/", "http://x.com/FR/": None,
        "http://com/de/1#a": "com/de/", "x://notorg/": None, "http://org": None, "http://org/": "org/", "nothing": None, "": None, "http://": None, "://e.org/?": "org/", "http://a.org:80/": None,
    }
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(cases)] + [(99, None, None), (None, "http://www.spam-farm.net/a", None), (98, "http://spam-farm.example.org/a", None)], "page_id bigint, url string, rule string")
    got = {r.page_id: r for r in urls.judge_urls(pages, urls.BASE_RULES + urls.PATTERN_RULES).collect()}
    assert [got[k].rule for k in range(len(cases))] == list(cases.values())
    assert (got[99].host, got[99].path, got[99].verdict) == ("", "", "allow") and got[None].verdict == "block" and got[98].verdict == "allow"
    assert urls.judge_urls(pages.limit(0), urls.BASE_RULES).count() == 0
    # Rules without a whole token of their own, as their last one may go on.
    bare = urls.BASE_RULES + (urls.prefix_rule("org", "", "block"), urls.prefix_rule("com", "/f", "block"), urls.prefix_rule("", "", "allow"))
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge_urls(pages, bare).collect()}
    assert got[7] == ("org", "block") and got[8] == ("org/", "allow") and got[3] == ("com/fr/", "allow")


def test_many_matches_in_one_text(spark):
    texts = [" ".join(f"é{k}@x.yz" for k in range(n)) for n in (1, 2, 3, 4, 5, 17, 2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find_pii(df).collect():
        assert [(s.kind, s.start, s.stop) for s in r.spans if s.kind in pii.BASE] == brute.pii(texts[r.doc_id])
    for r in pii.mask_pii(df).collect():
        assert r.text == re.sub(r"[0-9]+@x.yz", "[EMAIL]", texts[r.doc_id])


def test_results_of_the_queries(spark, docs, tmp_path):
    """The columns that op1, op2 and op8 return, on whole tables, against plain versions."""
    rows = [(k, t) for k, t in enumerate(EDGE)] + [(50, "write to a.b@example.org, 10.0.0.1, 4845168114407329 or +1 (017) 555-7713 🎉 x@y.zz")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    sf, texts = str(tmp_path), {k: t or "" for k, t in rows}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for r in bpe.op1_bpe(spark, sf).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert tuple(r) == (r.doc_id, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(texts[r.doc_id]))
    prints = {k: brute.simhash(t) for k, t in texts.items()}
    label = brute.components(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert {tuple(r) for r in simhash.op2_simhash(spark, sf).collect()} == {(k, f"{prints[k]:016x}", label[k]) for k in texts}
    for r in pii.op8_pii(spark, sf).collect():
        found = brute.pii(texts[r.doc_id])
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in found) for k in pii.BASE]
        assert r.base_sha256 == brute.sha(",".join(f"{k}:{a}:{b}" for k, a, b in found))
        assert {f"{k}:{a}:{b}" for k, a, b in found} <= set(r.spans.split(","))
    sizes = tokens.op6_token_counts(spark, sf)
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert {tuple(r) for r in sizes.collect()} == {(k, len(plain.encode_ordinary(t))) for k, t in texts.items()}


def test_bytes_that_are_not_utf8(spark):
    df = spark.sql("select 1 doc_id, cast(x'61ff20c328c3a9' as string) text union all select 2, 'plain'")
    got = {r.doc_id: bytes(r.decoded) for r in bpe.bpe_round_trip(df, bpe.multi_50k(spark)).collect()}
    assert got == {1: b"a\xff \xc3(\xc3\xa9", 2: b"plain"}
