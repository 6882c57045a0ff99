"""Runs, rank-file BPE and the filter audit: results and queries against brute force on hard rows."""

import base64
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from plangauge.llm import filter_audit, queries, rank_bpe, runs

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, IDS int, `odd ``name` string"


def table(spark, path, rows, labels=()):
    spark.createDataFrame([(i, t, lang, "s", 1, 7, "x") for i, t, lang in rows], DOCS).coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def hard(spark, tmp_path_factory):
    rnd = random.Random(7)
    words = ["".join(rnd.choices("abcdefgh", k=rnd.randint(1, 6))) for _ in range(300)]
    text = lambda n: " ".join(rnd.choices(words, k=n))
    base = text(260)
    rows = [(1, base, "en"), (2, base, "en"), (3, base + " ", None), (4, None, None), (5, "", "en"), (6, "  \t\n", ""), (7, "one", "en"), (8, "ONE TWO", "en"), (None, base, "de"), (None, text(40), "de")]
    rows += [(2, base, "en"), (2, text(30), "en"), (9, text(9000), "fr"), (10, "Zürich é 中 <|endoftext|> 1234!!  x\n \n y  ", "de"), (11, "a " * 5000, "fr"), (12, "spam & eggs # " * 80, "fr"), (13, "x" * 3000, "fr")]
    for i in range(80):
        w = []
        while len(w) < rnd.randint(1, 400):
            w += rnd.choices(words, k=rnd.randint(1, 30)) * rnd.choice([1, 1, 2, 3, 7])
        rows.append((100 + i, " ".join(w), rnd.choice(["en", "de", None])))
    rows += [(300 + i, rows[30 + i % 3][1], "en") for i in range(40)]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (None, 1, 1), (9, 1, 1), (11, 0, 1), (999, 1, 1), (301, None, 1)] + [(100 + i, i % 2, i % 3 == 0) for i in range(60)]
    return table(spark, tmp_path_factory.mktemp("hard"), rows, [(a, b, None if c is None else int(c)) for a, b, c in labels]), rows, labels


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return table(spark, tmp_path_factory.mktemp("empty"), [])


# ---- 11: runs


def brute_runs(w, least=12):
    out = []
    for q in range(1, len(w) // 2 + 1):
        same = [w[k] == w[k + q] for k in range(len(w) - q)] + [False]
        k = 0
        while k < len(same):
            j = k
            while same[j]:
                j += 1
            n = j - k + q
            if j > k and n >= max(least, 2 * q) and not any(all(w[k + t] == w[k + t + r] for t in range(n - r)) for r in range(1, q)):
                out.append((k, n, q))
            k = max(j, k) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("letters", [1, 2, 3])
def test_runs_of_short_alphabets(letters):
    rnd = random.Random(letters)
    for _ in range(300):
        w = [rnd.randrange(letters) for _ in range(rnd.randint(0, 60))]
        for least in (2, 12):
            assert sorted(runs.runs_of(w, least), key=lambda r: (r[0], r[2])) == brute_runs(w, least)


def test_stretches_keep_every_run_and_part_texts():
    rnd = random.Random(2)
    texts = []
    for _ in range(200):
        w = []
        while len(w) < 120:
            w += [str(rnd.randrange(40)) for _ in range(rnd.randint(1, 25))] * rnd.choice([1, 1, 2, 3, 6])
        texts.append(" ".join(w[: rnd.randint(1, 150)]))
    texts += ["a b c d e f", "a b c d e f", "", " "]  # halves of a run in two texts are no run
    found, rest = runs.find(pa.array(texts), 12)
    assert found == [brute_runs(t.split()) for t in texts]
    assert rest[-4:] == [b"a b c d e f", b"a b c d e f", b"", b""]


def planted(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else None
    if h is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_runs_query(spark, hard):
    sf, rows, _ = hard
    want = Counter()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t, _ in rows:
        w = planted(i, t)
        found = brute_runs(w) if len(w) < 3000 else [r for r in runs.runs_of(w)]
        found.sort(key=lambda r: (r[0], r[2]))
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        top = min(((-n, s, q) for s, n, q in found), default=None)
        best = (None,) * 4 if top is None else (top[1], -top[0], top[2], 1000 * -top[0] // top[2])
        want[(i, len(found), *best, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))] += 1
    got = queries.op11_runs(spark, sf)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(map(tuple, got.collect())) == want
    assert sum(n for k, n in want.items() if k[1]) > 20


def test_runs_keep_other_columns(spark, hard, empty):
    out = runs.with_runs(spark.read.parquet(f"{hard[0]}/documents.parquet").withColumn("Runs", F.lit(1)))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "IDS", "odd `name", "runs", "collapsed"]
    assert out.where("doc_id = 11").first().runs[0].asDict() == {"start": 0, "length": 5000, "period": 1}
    assert queries.op11_runs(spark, empty).count() == 0


# ---- 12: rank-file BPE


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_rank_bpe_query(spark, hard, reference):
    sf, rows, _ = hard
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for i, t, _ in rows:
        ids = reference.encode_ordinary(t or "")
        want[i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())] += 1
    assert Counter(map(tuple, queries.op12_rank_bpe(spark, sf).collect())) == want


def test_rank_bpe_of_odd_white_space_and_long_words(reference):
    rnd = random.Random(4)
    know = rank_bpe.Ranks(RANKS, public_tokenizers.PATTERN)
    texts = ["x   y", "x\n \ny", "x \n b", "a  ", "\n  b", " \n", "  a", "x 　 y", "a\x1cb \x1d c", "x\x85 y", "​᠎ x  y", "a" * 5001, "é" * 500, "it's we'll", "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=4000))]
    texts += ["".join(rnd.choices("abcdeft  \n\t　'sé中.!09", k=rnd.randint(0, 60))) for _ in range(2000)]
    ids = know.encode(pa.array(texts))
    assert ids.to_pylist() == [reference.encode_ordinary(t) for t in texts]
    assert know.decode(ids).to_pylist() == [t.encode() for t in texts]
    assert know.encode(pa.array([], pa.string())).to_pylist() == [] and know.encode(pa.array([""])).to_pylist() == [[]]


def test_ranks_whose_merges_come_out_of_order(tmp_path):
    """In a rank file that no training made, a merge may bring an earlier rank about: pairs of one rank are then taken one by one, as tiktoken takes them."""
    rnd = random.Random(9)
    for case in range(12):
        more = {"".join(rnd.choices("ab", k=rnd.randint(2, 5))).encode() for _ in range(12)}
        tokens = [bytes((b,)) for b in range(256)] + rnd.sample(sorted(more), len(more))
        path = tmp_path / f"{case}.tiktoken"
        path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % k for k, t in enumerate(tokens)))
        plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: k for k, t in enumerate(tokens)}, special_tokens={})
        know = rank_bpe.Ranks(str(path), public_tokenizers.PATTERN)
        texts = ["".join(rnd.choices("ab", k=rnd.choice([5, 30, 99, 200, 300]))) for _ in range(60)]
        assert know.encode(pa.array(texts)).to_pylist() == [plain.encode_ordinary(t) for t in texts]


def test_rank_bpe_keeps_columns_and_tells_bad_ids(spark, hard, empty):
    docs = spark.read.parquet(f"{hard[0]}/documents.parquet")
    out = rank_bpe.decode(rank_bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "odd `name", "ids", "decoded"]
    nothing = rank_bpe.decode(spark.createDataFrame([(None,), ([],)], "ids array<int>"), RANKS, public_tokenizers.PATTERN)
    assert [bytes(r.decoded) for r in nothing.collect()] == [b"", b""]
    with pytest.raises(Exception, match="not in the vocabulary"):
        rank_bpe.decode(spark.createDataFrame([([999999],)], "ids array<int>"), RANKS, public_tokenizers.PATTERN).collect()
    assert queries.op12_rank_bpe(spark, empty).count() == 0


# ---- 13: filter audit


def brute_masks(rows):
    out = []
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), copy]
        out.append((i, lang or "", sum(f << k for k, f in enumerate(fails))))
    return out


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0}, {"cells_per_row": 1}])
def test_masks(spark, hard, options):
    sf, rows, _ = hard
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = filter_audit.failure_masks(docs, part=F.coalesce("lang", F.lit("")), **options)
    assert Counter(map(tuple, got.collect())) == Counter(brute_masks(rows))


def test_counting_filter_clears_only_unique_keys(spark, tmp_path):
    rnd = random.Random(1)
    keys = [f"k{n}" for n in range(20000)] + [f"k{rnd.randrange(300)}" for _ in range(5000)] + ["hot"] * 9000
    spark.createDataFrame([(k.encode(),) for k in keys], "key binary").repartition(7).write.parquet(str(tmp_path / "k"))
    n = Counter(keys)
    for options in ({}, {"broadcast_bytes": 0}):
        rows = filter_audit.possible_repeats(spark.read.parquet(str(tmp_path / "k")), **options).collect()
        assert Counter(bytes(r.key).decode() for r in rows) == n
        assert all(r.maybe for r in rows if n[bytes(r.key).decode()] > 1)
        assert sum(r.maybe for r in rows if n[bytes(r.key).decode()] == 1) < 800


def test_audit_query(spark, hard, empty):
    sf, rows, labels = hard
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    parts = defaultdict(list)
    for i, part, mask in brute_masks(rows):
        parts[part].append((i, {f for k, f in enumerate("ABCDE") if mask >> k & 1}))
    want, shares = {}, Counter()
    for part, docs in parts.items():
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shares[part, f] += len(gone)
                fails = sum(f in d[1] for d in docs)
                want[part, "".join(order), step] = [len(left), len(gone), fails - len(gone), sum(d[1] == {f} for d in docs), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone)]
    got = queries.op13_filter_audit(spark, sf).collect()
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    assert {(r.part, r.filter_order, r.step): [r[c] for c in names] for r in got} == want and len(got) == len(want) == 600 * len(parts)
    assert all(r.shapley == shares[r.part, r.filter_order[r.step - 1]] for r in got)
    assert queries.op13_filter_audit(spark, empty).count() == 0


def test_audit_broadcasts_no_documents_and_no_labels(spark):
    failed = spark.range(50).selectExpr("id", "'en' AS part", "cast(id % 32 as int) AS mask")
    labels = spark.range(40).selectExpr("id", "1 AS good", "0 AS toxic")
    plan = filter_audit.mask_counts(failed, labels)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
