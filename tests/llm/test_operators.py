"""Every corpus operator on small tables: nulls, empty and long texts, ties and repeats, empty tables, clashing columns; results against brute force."""

import functools
import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plangauge.llm._bitmaps import mark
from plangauge.llm import bpe, exact_dedup, langid, minhash, packing, pii, sharding, token_counts, topk, url_filter

BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
DOCS = "doc_id long, text string, lang string, Shard int, `odd ``name` string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, 7, "x") for i, t, lang in rows], DOCS).coalesce(1)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Hard rows as a stored table: nulls, repeats, equal ids, empty, long."""
    rnd = random.Random(5)
    words = ["".join(rnd.choices("abcdefgh", k=rnd.randint(2, 6))) for _ in range(300)]
    text = lambda n: " ".join(rnd.choices(words, k=n))
    base = text(60)
    rows = [(1, base, "en"), (2, base.replace(" ", "\n"), "en"), (3, base + " extra", None), (4, None, None), (5, "", "en"), (6, "  \t\n", "fr"), (7, "one", "en"), (8, "ONE", "en"), (None, text(40), "de"), (None, text(40), "de"), (9, text(9000), "fr"), (10, base, "en"), (10, base, "en"), (10, text(30), "en"), (11, "Zürich é 中 <|endoftext|> 1234!!  x", "de")]
    rows += [(20 + i, text(rnd.randint(1, 80)), rnd.choice(["en", "de"])) for i in range(60)]
    path = str(tmp_path_factory.mktemp("docs") / "t")
    docs(spark, rows).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "t")
    docs(spark, []).write.parquet(path)
    return spark.read.parquet(path)


# ---- 1: sharding


def test_shards_are_even_gapless_and_whole(spark, stored, tmp_path):
    out = sharding.shard(stored, 4, bucket_bytes=2000)
    assert out.columns == ["doc_id", "text", "lang", "odd `name", "shard", "slot"]
    rows = out.collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in stored.collect())
    n = Counter(r.shard for r in rows)
    assert max(n.values()) - min(n.values()) <= 1 and set(n) == {0, 1, 2, 3}
    for s in n:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n[s]))
    assert rows == out.collect() or sorted(map(str, rows)) == sorted(map(str, out.collect()))
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot)) if r.doc_id and r.doc_id >= 20]
    assert order != sorted(order)
    sharding.write_shards(stored, str(tmp_path / "o"), 3)
    assert spark.read.parquet(str(tmp_path / "o")).count() == stored.count()


def test_sharding_nothing_and_few(spark, empty, stored):
    assert sharding.shard(empty, 4).count() == 0
    assert sorted(r.shard for r in sharding.shard(stored.limit(2), 16).collect()) == [0, 8]


# ---- 2: near duplicates


def _brute_components(rows, width, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset())
    up = list(range(len(rows)))
    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    return sets, [find(i) for i in range(len(rows))]


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_against_all_pairs(spark, tmp_path, width):
    rnd = random.Random(width)
    vocab = [f"w{i}" for i in range(400)]
    rows = [(k, t) for k, t in enumerate([None, "", "a", "A", "a b", "  "])]
    for f in range(12):
        base = rnd.choices(vocab, k=rnd.choice([6, 12, 60, 150]))
        for _ in range(rnd.randint(1, 9)):
            copy = [w if rnd.random() > 0.04 else rnd.choice(vocab) for w in base]
            rows.append((len(rows), " ".join(copy)))
    rows += [(3, rows[30][1]), (None, rows[31][1])]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    got = minhash.groups(df, minhash.Near(width=width, bands=48, rows=5)).orderBy("row").collect()
    order = [tuple(r) for r in df.collect()]
    sets, root = _brute_components(order, width, 80)
    assert [r.n for r in got] == [len(s) for s in sets]
    least = defaultdict(list)
    for (i, _), r in zip(order, root, strict=True):
        least[r].append(i)
    want = [min((x for x in least[r] if x is not None), default=None) for r in root]
    assert [r.component for r in got] == want
    kept = minhash.near_dedup(df, minhash.Near(width=width, bands=48, rows=5)).collect()
    assert len(kept) == len(set(root)) and Counter(map(tuple, kept)) <= Counter(order)


@pytest.mark.parametrize("broadcast_bytes", [64 << 20, 0])
def test_rows_are_marked_by_their_number(spark, broadcast_bytes):
    rows = spark.range(0, 200000, 3).withColumnRenamed("id", "place").withColumn("_pg_row", F.col("place") + (F.col("place") % 2) * (1 << 33))
    marked = rows.where("place % 7 = 0 or place = 199998").select("_pg_row")
    got = mark(rows, marked.unionByName(marked), "_pg_row", broadcast_bytes)
    assert set(got.columns) == {"place", "_pg_row", "_pg_marked"}
    assert got.count() == rows.count()
    assert got.where("_pg_marked <> (place % 7 = 0 or place = 199998)").count() == 0
    assert mark(rows, marked.limit(0), "_pg_row", broadcast_bytes).where("_pg_marked").count() == 0


def test_near_duplicates_of_nothing(spark, empty):
    assert minhash.near_dedup(empty).count() == 0


def test_densified_signatures_estimate_similarity():
    rnd = np.random.default_rng(1)
    a = np.unique(rnd.integers(0, 1 << 63, 200).astype(np.uint64) * np.uint64(2))
    b = np.concatenate([a[:160], np.unique(rnd.integers(0, 1 << 63, 40).astype(np.uint64) * np.uint64(2))])
    for x, y in ((a, np.sort(b)), (a[:5], a[:4])):
        sig = minhash.signatures([x, y], 2000)
        want = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        assert abs((sig[0] == sig[1]).mean() - want) < 0.08


# ---- 3: packing


def test_packing_gives_each_token_once(spark, stored, empty):
    from tokenizers import Tokenizer

    p = packing.Packing(window=256, shard_tokens=3000)
    pieces = packing.pack(stored, WORD, p).collect()
    t = Tokenizer.from_file(WORD)
    want = Counter(tuple([*t.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in stored.collect())
    by = defaultdict(list)
    for r in pieces:
        by[r.sequence_id].append(r)
    for rs in by.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at and len(r.ids) == 4 * r.length
            at += r.length
        assert at == 256 or at & (at - 1) == 0
    assert sum(r.length for r in pieces) == sum(len(k) * n for k, n in want.items())
    ids = defaultdict(dict)
    for r in pieces:
        if r.id is not None and r.id != 10:
            ids[r.id][r.start] = np.frombuffer(r.ids, "<u4").tolist()
    for r in stored.where("doc_id <> 10").collect():
        assert sum((ids[r.doc_id][s] for s in sorted(ids[r.doc_id])), []) == [*t.encode(r.text or "", add_special_tokens=False).ids, 2]
    assert packing.pack(empty, WORD).count() == 0


def test_word_ids_match_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    rnd = random.Random(4)
    bits = ["a", "B", " ", "  ", "\n", "\t", "\v", "é", "É", "ß", "'s", "'LL", "'", "1", "23", "²", "ª", "\xad", ".", "!!", "<|endoftext|>", "<|", "中", "\u3000", "\xa0", "\x1c", "\x85", "the", "İ", "Ÿ", "🙂", "e\u0301", "٣", "_", "\r\n", "ſ", "Σ", "\x00"]
    plain = [b for b in bits if re.fullmatch(r"[\t\n\v\r\x20-\x7e\xa1-\u012f\u0131-\u024f]+", b) and b != "<|endoftext|>"]
    odd = ["".join(rnd.choices(plain if k % 2 else bits, k=rnd.randint(0, 14))) for k in range(3000)] + ["", "a" * 3000, " " * 300, "ab'" * 500]
    ids, n = packing.token_ids(pa.array(odd), WORD)
    for text, got in zip(odd, np.split(ids, np.cumsum(n)[:-1]), strict=True):
        assert got.tolist() == t.encode(text, add_special_tokens=False).ids, text
    assert packing.token_ids(pa.array([], pa.string()), WORD)[0].size == 0


def test_documents_that_share_rare_terms_meet():
    found = np.array([2, 2, 50, 50, 1, 0])
    for rank, order in packing.draw_tables(np.log1p((60 - found + 0.5) / (found + 0.5)), found, packing.Packing()):
        assert rank[order].tolist() == list(range(6)) and set(order[4:]) == {4, 5}


def test_a_window_is_filled_by_the_nearest_unused(spark):
    p = packing.Packing(window=16)
    docs_ = [np.array([5, 6, 7, 8, 2]), np.array([100, 101, 102, 2]), np.array([5, 6, 7, 9, 2]), np.array([200, 201, 202, 203, 204, 205, 2])]
    idf = np.ones(300)
    out = packing.pack_shard(docs_, idf, 5.0, p)
    assert [d for d, *_ in out][:2] == [0, 2]


def test_scores_count_all_terms_of_a_long_seed():
    rnd = random.Random(9)
    docs_ = [np.array(rnd.sample(range(400), n)) for n in (300, 200, 60, 40, 90, 10)] + [np.array([5, 5, 7]), np.arange(50), np.arange(350, 400)]
    sizes, p = [len(d) for d in docs_], packing.Packing()
    mean, found = sum(sizes) / len(sizes), np.array([sum(t in d for d in docs_) for t in range(400)])
    idf = np.log1p((len(docs_) - found + 0.5) / (found + 0.5))
    index = packing.Index(docs_, idf, mean, p)
    for seed, q in enumerate(docs_):
        want = [sum(idf[t] * tf * (p.k1 + 1) / (tf + p.k1 * (1 - p.b + p.b * len(d) / mean)) for t in set(q.tolist()) if (tf := (d == t).sum())) for d in docs_]
        assert index.neighbours(seed) == pytest.approx(want)


# ---- 4: language


def test_language_by_brute_force_parse(spark, empty):
    rnd = random.Random(1)
    make = {"aa": lambda: "".join(rnd.choices(["ka", "lo", "mi"], k=5)), "bb": lambda: "".join(rnd.choices(["sch", "ung", "der"], k=4))}
    rows = [(i, " ".join(make[g]() for _ in range(30)), g) for i in range(40) for g in [rnd.choice(["aa", "bb"])]]
    rows += [(100, None, "aa"), (101, "", None), (102, "123 !!", "bb"), (103, rows[0][1], rows[0][2]), (None, rows[1][1], None), (104, make["aa"]() * 5000, None)]
    df = docs(spark, rows)
    samples = langid.fit(df.where(langid.may_learn(F.col("doc_id"))))
    got = langid.identify(df.withColumn("score", F.lit("old")), samples).collect()
    table, steps, starts, logs = langid._models(tuple(samples))
    def parse(codes, train):
        n, i, s = 0, 0, ""
        text = "".join(map(chr, codes))
        while i < len(text):
            k = 1
            while i + k <= len(text) and text[i : i + k] in train:
                k += 1
            i += max(1, k - 1)
            n += 1
        return n
    for r, (_, t, g) in zip(got, rows, strict=True):
        if not any(c.isalpha() for c in t or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        if g is not None or t is None:
            assert r.lang_pred == g
        if len(t) < 1000:
            codes = langid.codes_of(t, table)
            cost = [parse(codes, "".join(map(chr, langid.codes_of(s, table)))) for _, s in samples]
            assert cost == langid.phrases([codes], steps, starts)[0].tolist()
            many = langid.phrases([codes[: k + 1] for k in range(60)] + [codes] * 2, steps, starts)
            assert many[-1].tolist() == cost and many[40].tolist() == langid.phrases([codes[:41]], steps, starts)[0].tolist()
        assert 0 <= r.score <= 1
    assert langid.identify(df, []).where("lang_pred <> 'und'").count() == 0
    assert langid.fit(empty) == [] and langid.identify(empty, samples).count() == 0


def test_copies_of_one_text_do_not_crowd_out_a_language(spark):
    crowd = spark.range(60_000).select(F.lit("copy of copies").alias("text"), F.lit("aa").alias("lang"))
    rest = spark.range(100).select(F.concat(F.lit("kalo "), F.col("id").cast("string")).alias("text"), F.lit("aa").alias("lang"))
    many = spark.range(2000).select(F.concat(F.lit("ung "), F.col("id").cast("string")).alias("text"), F.lit("bb").alias("lang"))
    (a, x), (b, y) = langid.fit(crowd.union(rest).union(many))
    assert (a, b) == ("aa", "bb") and x.count("kalo") == 100 and x.count("copy of") == 1 and y.count("ung") == 256
    long = spark.createDataFrame([("lo " * 90, "cc"), ("li " * 50, "cc"), ("la " * 70, "cc")], "text string, lang string")
    assert langid.fit(long, langid.Parsing(lang_chars=100)) == [("cc", "li " * 50)]


def test_letters_over_all_of_unicode(spark):
    gothic, deseret = "\U00010330\U00010331\U00010332", "\U00010428\U00010429\U0001042a"
    samples = [("aa", "kalo milo kalo"), ("de", f"{deseret} {deseret}"), ("go", f"{gothic} {gothic}")]
    texts = ["\U0001f600\U0001f680 \U0001f44d", "\U0010ffff", "!? kalo ! milo", "\U0001f600 kalo \U0001f680 milo", gothic, deseret, "\U00010400\U00010401\U00010402"]
    got = langid.identify(spark.createDataFrame(list(enumerate(texts)), "i long, text string"), samples).orderBy("i").collect()
    assert [r.lang_pred for r in got] == ["und", "und", "aa", "aa", "go", "de", "de"]
    assert got[0].score == got[1].score == 0 and got[2].score == got[3].score > 0


# ---- 5: token counts


def test_token_counts_by_brute_force(spark, stored, empty):
    scores = token_counts.zipf_scores(PIECE)
    trie = token_counts.Trie(scores)
    def viterbi(w):
        best = [(0.0, 0)] + [None] * len(w)
        for e in range(1, len(w) + 1):
            for s in range(e):
                x, n = (scores[w[s:e]], 1) if w[s:e] in scores else (trie.unknown, len(w[s].encode())) if e - s == 1 else (None, 0)
                if x is not None and (best[e] is None or (best[s][0] + x, -best[s][1] - n) > (best[e][0], -best[e][1])):
                    best[e] = best[s][0] + x, best[s][1] + n
        return best[-1]
    assert trie.add(["x" * 200_000 + "yz"])[0][1] > 0 and len(trie.strings) < 1000
    got = token_counts.count_tokens(stored, PIECE).collect()
    viterbi = functools.cache(viterbi)
    for r in got:
        ws = re.findall(r"[^ \t\n\x0b\f\r]+", r.text or "")
        each = [viterbi("▁" + w) for w in ws]
        assert r.n_words == len(ws) and r.n_tokens == sum(n for _, n in each)
        assert r.log_score == pytest.approx(sum(s for s, _ in each))
    assert token_counts.count_tokens(empty, PIECE).count() == 0


# ---- 6: top k


def test_top_k_against_all_pairs(spark):
    rnd = random.Random(3)
    rows = [(i, [round(rnd.gauss(0, 0.4), 3) for _ in range(8)]) for i in range(240)]
    rows += [(300, rows[0][1]), (301, rows[0][1]), (302, None), (303, [1.0, None] * 4), (304, [float("nan")] * 8), (305, [float("inf")] * 8), (306, [1.0, 2.0]), (307, []), (300, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = df.where("vec_id % 50 = 0")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df, q, 5, block=60, query_block=3, bits=3).where("query_id <> 300").collect()}
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v)]
    for i, v in ok:
        if i % 50 == 0 and i != 300:
            best = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in ok if j != i))[:5]
            assert [got[i, k + 1] for k in range(5)] == [(j, -s) for s, j in best]
    assert topk.top_k(df.limit(0), q, 5).count() == 0
    big = spark.createDataFrame([(0, [1.5e13, 1e13]), (1, [1e13, 1.0]), (2, [-3e12, 0.5]), (3, [1e30, 0.0])], "vec_id long, embedding array<double>")
    got_big = topk.top_k(big, big.where("vec_id = 0"), 5).collect()
    assert [(r.vec_id, r.score) for r in got_big] == [(1, (1 << 63) - 1), (2, -(1 << 63))]
    one = topk.top_k(df.where("vec_id IN (50, 51, 52)"), df.where("vec_id = 50"), 5).collect()
    assert len(one) == 2


# ---- 7: URLs


def test_urls(spark):
    urls = [None, "no scheme", "http://A.Example.COM/en/1?x#y", "https://example.com/en/77", "x://net/de/", "ftp://h.example.net/de/80", "http://host", "http://bad.org/p#/es/", "a://b://c/d", "http://s.org/es/?q", "http:///en/1"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, Host string")
    seen = spark.createDataFrame([("bad.org", True)] * 60 + [("host", False)] * 60 + [("gone.net", False)] * 20, "host string, bad boolean")
    rules = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
    r = {x.page_id: x for x in url_filter.judge(pages, seen, rules).collect()}
    assert len(r) == len(urls)
    assert [(r[i].host, r[i].path) for i in (0, 1, 2, 8, 10)] == [("", ""), ("", ""), ("a.example.com", "/en/1"), ("b:", "//c/d"), ("", "/en/1")]
    assert [(r[i].rule, r[i].verdict) for i in (2, 3, 4, 5, 9)] == [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
    assert [(r[i].rule, r[i].verdict) for i in (6, 7)] == [(None, "allow"), (None, "block")]
    assert url_filter.judge(pages.limit(0), seen.limit(0), rules).count() == 0
    assert {x.verdict for x in url_filter.judge(pages, seen.limit(0), rules).where("rule IS NULL").collect()} == {"allow"}


# ---- 8: personal data


def test_pseudonyms_keep_format_and_links(spark, empty):
    t = "ssn 123-45-6789 born 1980-02-29, 29.02.1980 or 02/29/1980; (415) 555-0199, 415-555-0199, +1 415 555 0199; 999.1.1.1 1.2.3.4; 4111 1111 1111 1111 4111111111111111; 4111111111111112; 2023-13-45; A.b@x.example.com a.B@x.example.com"
    df = docs(spark, [(1, t, "en"), (2, "see 1.2.3.4 again", "en"), (3, None, None), (4, "", "en"), (5, "clean text, 42 apples, v1.2.3, 3 Jan 1999", "en"), (1, t, "en"), (6, "1.2.3.4 " * 3000, "en")])
    out = pii.pseudonymise(df, "key", count_col="n")
    assert out.columns == [*df.columns, "n"]
    r = out.collect()
    a = r[0].text
    m = re.fullmatch(r"ssn (\d{3}-\d\d-\d{4}) born (\d{4})-(\d\d)-(\d\d), (\d\d)\.(\d\d)\.(\d{4}) or (\d\d)/(\d\d)/(\d{4}); \((\d{3})\) (\d{3})-(\d{4}), (\d{3})-(\d{3})-(\d{4}), \+1 (\d{3}) (\d{3}) (\d{4}); 999\.1\.1\.1 (\d+\.\d+\.\d+\.\d+); (\d{4} \d{4} \d{4} \d{4}) (\d{16}); 4111111111111112; 2023-13-45; (\S+)@x\.example\.com (\S+)@x\.example\.com", a).groups()
    assert m[0] != "123-45-6789" and (m[1], m[2], m[3]) == (m[6], m[5], m[4]) == (m[9], m[7], m[8])
    assert m[10:13] == m[13:16] == m[16:19] != ("415", "555", "0199")
    assert m[20].replace(" ", "") == m[21] != "4111111111111111"
    assert sum(int(c) if i % 2 else sum(divmod(int(c) * 2, 10)) for i, c in enumerate(m[21])) % 10 == 0
    assert m[22] == m[23] and re.fullmatch(r"[a-z]\.[a-z]", m[22]) and r[1].text == f"see {m[19]} again"
    assert (r[2].text, r[3].text, r[4].text, r[4].n) == (None, "", df.collect()[4].text, 0) and r[5].text == a
    assert r[6].text == (m[19] + " ") * 3000 and r[6].n == 3000
    assert pii.pseudonymise(df, "other").first().text != a and pii.pseudonymise(empty, "key").count() == 0


def test_cards_and_phones_beside_other_digits(spark):
    card, amex = "4111 1111 1111 1111", "3782 822463 10005"
    texts = [f"{card} 12/26", f"{card} 123", "4111111111111111 737", f"item 77 {card}", f"1234 {card}", f"{amex} 1234", f"{card} 555-123-4567", f"(415) 555-0199 {card} 2020-02-29", "10 41111 11111 111111 1", f"{card} {card}", f"{card} 12th"]
    texts += ["555 123 4567", "x\n555 123 4567", "tel:555 123 4567", "call 555 123 4567", "12 555-123-4567 1234", "4111 1111 1111 1112 12", "1234567890123456 99", "4111 1111 1111 1111a", " ".join(["4111-1111-1111-1111"] * 2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    got = {r.i: (r.text, r.n) for r in pii.pseudonymise(df, "key", count_col="n").collect()}
    c, p = pii.pseudonymise(spark.createDataFrame([(card,), ("415-555-0199",)], "text string"), "key").collect()
    c, p = c.text, p.text
    t = lambda i: got[i][0]
    assert c != card and (t(0), t(1), t(2), t(3), t(4)) == (f"{c} 12/26", f"{c} 123", f"{c.replace(' ', '')} 737", f"item 77 {c}", f"1234 {c}")
    assert t(5) != texts[5] and t(5).endswith(" 1234") and re.fullmatch(r"\d{4} \d{6} \d{5} 1234", t(5))
    assert t(6).startswith(c + " ") and "555-123-4567" not in t(6) and got[6][1] == 2
    assert t(7).startswith(f"({p[:3]}) {p[4:]} {c} ") and "2020-02-29" not in t(7) and got[7][1] == 3
    assert t(8) == f"10 {''.join(x for x in c if x != ' ')[:5]} {c.replace(' ', '')[5:10]} {c.replace(' ', '')[10:]} 1"
    assert (t(9), t(10)) == (f"{c} {c}", f"{c} 12th")
    phones = {re.search(r"\d{3} \d{3} \d{4}", t(i))[0] for i in (11, 12, 13, 14)}
    assert len(phones) == 1 and phones != {"555 123 4567"} and t(15) == f"12 {phones.pop().replace(' ', '-')} 1234"
    assert [t(i) for i in (16, 17, 18)] == [texts[i] for i in (16, 17, 18)] and [got[i][1] for i in (16, 17, 18)] == [0, 0, 0]
    assert got[19] == (" ".join([c.replace(" ", "-")] * 2000), 2000)


def test_permutations_are_bijective(spark):
    d = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    assert d.select(pii.permuted_digits(F.col("d"), "k", F.lit("t")).alias("p")).where("length(p) = 3").distinct().count() == 1000
    days = spark.range(2000).select(F.date_format(F.date_add(F.lit("1999-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
    assert days.select(pii._date(F.col("d"), "k").alias("p")).distinct().count() == 2000


def _feistel(a, b, m, n, key, tweak):
    """The network in plain Python: ten rounds, halves of sizes m and n by turns."""
    left, right = m, n
    for i in range(10):
        mac = hashlib.sha256("|".join(map(str, (key, tweak, left, right, i, b))).encode()).hexdigest()[:15]
        a, b = b, (a + int(mac, 16)) % (left if i % 2 == 0 else right)
    return a, b


def test_pseudonyms_against_a_network_in_python(spark):
    rnd = random.Random(8)
    ssn = [f"{rnd.choice([*range(1, 666), *range(667, 900)]):03}-{rnd.randint(1, 99):02}-{rnd.randint(1, 9999):04}" for _ in range(400)]
    ips = [".".join(str(rnd.randint(0, 255)) for _ in range(4)) for _ in range(400)]
    df = spark.createDataFrame([(" ".join(x),) for x in zip(ssn, ips, strict=True)], "text string")
    for before, after in zip(zip(ssn, ips, strict=True), (r.text.split() for r in pii.pseudonymise(df, "key").collect()), strict=True):
        area, group, serial = map(int, before[0].split("-"))
        a, b = _feistel(area - (2 if area > 666 else 1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, "key", "ssn")
        assert after[0] == f"{a + (2 if a >= 665 else 1):03}-{b // 9999 + 1:02}-{b % 9999 + 1:04}"
        o = list(map(int, before[1].split(".")))
        a, b = _feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "key", "ipv4")
        assert after[1] == f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"


def test_values_of_a_format_stay_apart(spark):
    dates = ["1800-01-01", "2200-01-01", "0001-01-01", "9999-12-31", *(f"{d}/{m:02}/{y}" for y in (1999, 2020) for m in range(1, 13) for d in range(13, 29)), *(f"{m:02}/{d}/{y}" for y in (1999, 2020) for m in range(1, 13) for d in range(13, 29))]
    stay = ["01.2.3.4", "000-12-1234", "666-12-1234", "900-12-1234", "123-00-1234", "123-12-0000", "000-000-0000"]
    df = spark.createDataFrame([(x,) for x in dates + stay], "text string")
    got = [r.text for r in pii.pseudonymise(df, "key").collect()]
    assert len(set(got[: len(dates)])) == len(dates) and got[len(dates) :] == stay
    assert all(int(g[:2]) > 12 for d, g in zip(dates, got, strict=False) if d[2] == "/" and int(d[:2]) > 12)
    assert all(re.sub("[0-9]", "0", d) == re.sub("[0-9]", "0", g) for d, g in zip(dates, got, strict=False))


# ---- 9: BPE


def test_bpe_matches_the_library(spark, stored, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE)
    rnd = random.Random(2)
    bits = ["a", "B", " ", "  ", "\n", "\t", "é", "ß", "'s", "'ll", "1", "23", ".", "!!", "<|endoftext|>", "中", "\u3000", "\xa0", "\x1c", "\x85", "the", "ing", "🙂", "\u0301", "٣", "_", "\r\n"]
    odd = ["".join(rnd.choices(bits, k=rnd.randint(0, 14))) for _ in range(1500)] + ["", "a" * 3000, " " * 300, "".join(rnd.choices("abehnt", k=20_000)), "é中" * 400, "x" + " the" * 300 + "  "]
    ids, n = bpe.encode_batch(pa.array(odd), BYTE)
    back = bpe.decode_batch(ids, n, BYTE)
    for text, got, dec in zip(odd, np.split(ids, np.cumsum(n)[:-1]), back, strict=True):
        assert got.tolist() == t.encode(text, add_special_tokens=False).ids
        assert dec == t.decode(got.tolist(), skip_special_tokens=False) == text
    rows = bpe.encode(stored, BYTE, decoded_col="back").collect()
    assert all(r.ids == t.encode(r.text or "", add_special_tokens=False).ids and r.back == (r.text or "") for r in rows)
    assert bpe.encode(empty, BYTE).count() == 0


# ---- 10: exact copies


def test_exact_copies(spark, stored, empty):
    keys = [(r.doc_id, re.sub(r"[\x20\x09-\x0d]+", " ", r.text or "")) for r in stored.collect()]
    by = defaultdict(list)
    for i, t in keys:
        by[t].append(i)
    tagged = stored.select("doc_id", exact_dedup.fingerprint(F.col("text")).alias("text_key"))
    for options in ({}, {"bits_per_row": 1}, {"broadcast_bytes": 0}):
        got = exact_dedup.resolve(tagged, **options).collect()
        want = Counter((i, min((x for x in by[t] if x is not None), default=None), len(by[t]), hashlib.sha256(t.encode()).digest()) for i, t in keys)
        assert Counter((r.doc_id, r.keep_id, r.group_size, bytes(r.text_key)) for r in got) == want
        assert sum(r.kept for r in got) == len(by)
    kept = exact_dedup.drop_copies(stored)
    assert kept.columns == stored.columns and kept.count() == len(by)
    first = {}
    for r in stored.collect():
        t = re.sub(r"[\x20\x09-\x0d]+", " ", r.text or "")
        if t not in first or (r.doc_id is not None and (first[t].doc_id is None or r.doc_id < first[t].doc_id)):
            first[t] = r
    assert Counter(map(tuple, kept.collect())) == Counter(map(tuple, first.values()))
    assert exact_dedup.drop_copies(empty).count() == 0 and exact_dedup.resolve(empty.selectExpr("doc_id", "unhex(sha2(text, 256)) AS text_key")).count() == 0


# ---- the pipeline


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline as cp
    from tokenizers import Tokenizer

    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").write.parquet(str(tmp_path / "documents.parquet"))
    pieces = cp.run(spark, str(tmp_path)).collect()
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(str(tmp_path / "documents.parquet")).collect())
    rows = [(i, t) for i, t in rows if any(c.isalpha() for c in t or "")]
    first = {}
    for i, t in rows:
        first.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", t), (i, t))
    rows = sorted(first.values())
    _, root = _brute_components(rows, 5, 80)
    least = {}
    for (i, t), r in zip(rows, root, strict=True):
        least.setdefault(r, (i, t))
    assert {r.doc_id for r in pieces} == {i for i, _ in least.values()}
    tok = Tokenizer.from_file(WORD)
    changed = pii.pseudonymise(spark.createDataFrame(sorted(least.values()), "doc_id long, text string"), cp.PII_KEY).collect()
    want = {r.doc_id: [*tok.encode(r.text, add_special_tokens=False).ids, 2] for r in changed}
    for r in pieces:
        part = want[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and r.doc_tokens == len(want[r.doc_id])
    assert sum(r.length for r in pieces) == sum(map(len, want.values()))
    assert [n for n, _ in cp.STAGES] == ["language", "exact_copies", "near_copies", "private_data", "packed"]
