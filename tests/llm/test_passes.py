"""Whitening, periodic runs and byte-level BPE against brute force."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kmerlake.llm import bytebpe, common, periodic, tokenfiles, whitening
from kmerlake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, T double, c0 int"


# whitening


def brute_whitening(vectors):
    rows = [v for v in vectors if v[1] and all(e is not None and math.isfinite(e) for e in v[1])]
    x = [[math.floor(1024 * float(np.float32(e))) + 100000 for e in v] for _, v in rows]
    n, total = len(x), [sum(c) for c in zip(*x)]
    centred = np.array([[(n * a - s) / n for a, s in zip(row, total)] for row in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, total)) for row in x]
    return rows, n, deviation, centred @ axes / np.sqrt(values), values / values.sum()


@pytest.mark.parametrize("dim", [1, 3, 12])
def test_whitening_equals_brute_force(spark, dim):
    r = np.random.default_rng(dim)
    mixing = r.normal(size=(dim, dim))
    vectors = [(i, (mixing @ r.normal(size=dim)).tolist()) for i in range(500)]
    vectors += [(7, vectors[7][1]), (None, vectors[8][1]), (900, None), (901, []), (902, [None] * dim), (903, [math.nan] * dim), (904, [math.inf] * dim)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(7).withColumn("n", F.lit(1)).withColumn("i", F.lit("x"))
    got = whitening.whiten(df).toPandas()
    rows, n, deviation, white, explained = brute_whitening(vectors)
    assert len(got) == len(rows) * min(8, dim) and set(got.n) == {n}
    assert got.identity_error.max() < 1e-9 and got.identity_error.nunique() == 1
    for c, part in got[got.vec_id.notna() & (got.vec_id != 7)].groupby("component"):
        want = {i: (d, w) for (i, _), d, w in zip(rows, deviation, white[:, c - 1])}
        sign = np.sign(part.whitened.iloc[0] * want[part.vec_id.iloc[0]][1])
        assert part.deviation.tolist() == [want[i][0] for i in part.vec_id]
        np.testing.assert_allclose(part.whitened, [sign * want[i][1] for i in part.vec_id], rtol=1e-8, atol=1e-8)
        np.testing.assert_allclose(part.explained, explained[c - 1], rtol=1e-9)


def test_whitening_of_edge_cases(spark):
    kind = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], kind)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, kind)).collect()
    assert len(one) == 6 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.identity_error == 0 for r in one)
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)] + [(9, [3.0]), (10, [5.0])], kind)).collect()
    assert sorted({(r.vec_id, r.n) for r in flat}) == [(i, 5) for i in range(5)] + [(9, 2), (10, 2)]
    assert all((r.whitened is None) == (r.component == 2) for r in flat)
    wide = whitening.whiten(spark.createDataFrame([(0, [1e9, 0.0]), (1, [-1e9, 4.0]), (2, [1e300, 1.0])], kind)).collect()
    assert {r.vec_id for r in wide} == {0, 1} and all(r.deviation == 8 * (1024 * 10**9) ** 2 // 2 // 1 + 2 * (1024 * 4) ** 2 if r.deviation is not None else True for r in wide)


def test_deviation_is_exact_for_large_counts():
    r = np.random.default_rng(1)
    for n, size in ((3, 100), (10**6, 1000), (10**11, 10**5), (5, 10**12)):
        x = r.integers(-size, size, (4, 6)) + 100000
        total = [int(t) * n // 4 + 1 for t in x.sum(0)]
        m = whitening.Whitening(n, total, np.ones(6), np.eye(6), 6.0)
        want = [sum((n * int(a) - t) ** 2 for a, t in zip(row, total)) for row in x]
        assert m.deviation(x) == [v if v < 1 << 63 else None for v in want]


def test_moments_are_those_of_single_updates_and_merges():
    r = np.random.default_rng(2)
    x = r.integers(0, 1000, (5000, 5)) + 10**6
    n, mean, scatter = 0, np.zeros(5), np.zeros((5, 5))
    for v in x.astype(float):
        n += 1
        away = v - mean
        mean = mean + away / n
        scatter += np.outer(away, v - mean)
    whole, parts = whitening.Moments(5), whitening.Moments(5)
    whole.add(x)
    for part in np.array_split(x, 9):
        m = whitening.Moments(5)
        m.add(part)
        parts.merge(m)
    for m in (whole, parts):
        np.testing.assert_allclose(m.scatter, scatter, rtol=1e-10)
        np.testing.assert_allclose(m.mean, mean, rtol=1e-13)
        assert list(m.total) == x.sum(0).tolist() and m.n == n


def test_symmetric_qr():
    r = np.random.default_rng(3)
    for n in (1, 2, 3, 10, 64):
        for a in (r.normal(size=(n, n)), np.diag(np.arange(float(n))), np.ones((n, n)), np.zeros((n, n)), np.kron(np.eye(n), [[2.0, 1], [1, 2]])):
            a = a + a.T
            values, axes = whitening.symmetric_qr(a)
            np.testing.assert_allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-11 * max(1, np.abs(a).max()) * n)
            np.testing.assert_allclose(axes.T @ axes, np.eye(len(a)), atol=1e-12)
            np.testing.assert_allclose(a @ axes, axes * values, atol=1e-11 * max(1, np.abs(a).max()) * n)


# periodic runs


def brute_runs(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(6, 4 * q):
                part = words[i : i + size]
                if not any(all(part[k] == part[k + p] for k in range(size - p)) for p in range(1, q)):
                    out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_kept(words, runs):
    lost = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in lost)


def test_runs_equal_brute_force(monkeypatch):
    r = random.Random(5)
    for _ in range(1500):
        words = [str(r.randrange(r.choice([1, 2, 3, 6]))) for _ in range(r.randint(0, 50))]
        if r.random() < 0.6:
            words[r.randint(0, len(words)) : 0] = words[: r.randint(1, 7)] * r.randint(2, 9)
        numbers, known = periodic.word_numbers(" \n".join(words).encode())
        want = brute_runs(words)
        monkeypatch.setattr(periodic, "TABLE", 1 << 15)
        assert periodic.runs_of(numbers) == want
        monkeypatch.setattr(periodic, "TABLE", 2)
        assert periodic.runs_of(numbers) == want
        assert periodic.collapsed(numbers, known, want).decode() == brute_kept(words, want)


def test_words_over_pieces(monkeypatch):
    monkeypatch.setattr(periodic, "PIECE", 5)
    r = random.Random(6)
    for _ in range(500):
        raw = bytes(r.choice(b"ab \n\t\x1c") for _ in range(r.randint(0, 60)))
        numbers, known = periodic.word_numbers(raw)
        assert [known[i] for i in numbers] == raw.split()


def test_runs_of_a_long_text():
    for words, want in ((["x"] * 300_000, [(0, 300_000, 1)]), ([str(i % 5000) for i in range(100_000)], [(0, 100_000, 5000)]), ([str(i) for i in range(100_000)], [])):
        numbers, _ = periodic.word_numbers(" ".join(words).encode())
        assert periodic.runs_of(numbers) == want


def test_periodic_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(100, None), (101, ""), (102, " \n"), (103, "a " * 6), (103, "a " * 6), (None, "é b " * 9), (110, "one"), (121, "x\x1cy z " * 5), *((i, f"w{i} " * 3) for i in range(10_000, 10_200))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    out = periodic.periodic_runs(periodic.with_planted_runs(frame)).collect()
    want = []
    planted = 0
    for i, text in docs:
        words = [w for w in (text or "").encode().split()]
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
            planted += 1
        words = [w.decode() for w in words]
        runs = brute_runs(words) if n < 300 else None
        want.append((i, runs, brute_kept(words, runs) if runs is not None else None))
    assert planted > 10 and len(out) == len(want)
    key = lambda t: (t[0] is None, t[0] or 0)
    for r, (i, runs, kept) in zip(sorted(out, key=lambda r: key((r.doc_id,))), sorted(want, key=lambda w: key((w[0],)))):
        assert r.doc_id == i
        if runs is not None:
            assert [tuple(x) for x in r.runs] == runs and r.collapsed == kept


def test_periodic_digests(spark, tmp_path):
    docs = [(1, "a b " * 5 + "q " * 9 + "q"), (2, None), (3, "u v w")]
    path = str(tmp_path / "sf")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, path).collect()}
    assert not any(zlib.crc32(str(i).encode()) % 10 == 0 for i in (1, 2, 3))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert tuple(got[1]) == (1, 2, 0, 10, 2, 5000, sha("0,10,2\n10,10,1\n"), sha("a b q"))
    assert tuple(got[2]) == (2, 0, None, None, None, None, sha(""), sha("")) and got[3].collapsed_sha256 == sha("u v w")


def test_periodic_runs_of_odd_tables(spark):
    assert periodic.periodic_runs(spark.createDataFrame([], DOCS)).count() == 0
    odd = spark.createDataFrame([(1, "a " * 8, "x", 1.0, 2)], DOCS).withColumnRenamed("lang", "Runs")
    out = periodic.periodic_runs(odd)
    assert out.columns == ["doc_id", "text", "T", "c0", "runs", "collapsed"] and out.first().collapsed == "a"


# byte-level BPE


@pytest.fixture(scope="module")
def oracle():
    import public_tokenizers as p
    import tiktoken

    ranks = bytebpe.read_ranks(p.path("byte_bpe_50k.tiktoken"))
    return ranks, tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_every_code_point_in_context(oracle):
    import public_tokenizers as p

    ranks, enc = oracle
    codec = bytebpe.ByteBPE(ranks, p.PATTERN)
    assert codec.plane is not None
    texts = [f"a{chr(c)}a {chr(c)}1{chr(c)} \n" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(texts), 50_000):
        part = texts[at : at + 50_000]
        assert [np.frombuffer(x, "<i4").tolist() for x in codec.encode(part)] == enc.encode_ordinary_batch(part, num_threads=4)


def test_ids_and_bytes_of_a_table(spark, oracle):
    _, enc = oracle
    r = random.Random(7)
    texts = [None, "", " ", "\n" * 5, "x" * 3000, "The cat's 12 hats", "🙂🙂 漢字\x00\x1c  ", "<|endoftext|>", *("".join(r.choice("abc '\n\t\x85é漢🙂19sThe  ") for _ in range(r.randint(0, 90))) for _ in range(300))]
    df = spark.createDataFrame([(i if i % 7 else None, t, "x", 0.5, i) for i, t in enumerate(texts)], DOCS).withColumn("IDS", F.lit(1)).repartition(3)
    out = bytebpe.decoded(bytebpe.encoded(df))
    assert out.columns == ["doc_id", "text", "lang", "T", "c0", "ids", "decoded"]
    rows = out.collect()
    assert len(rows) == len(texts)
    once = bytebpe.encoded(df.drop("IDS").withColumn("B", F.lit(0)), bytes_col="b")
    assert once.columns == ["doc_id", "text", "lang", "T", "c0", "ids", "b"]
    for row in once.collect():
        assert bytes(row.b) == (texts[row.c0] or "").encode()
    for row in rows:
        text = texts[row.c0] or ""
        assert row.ids == enc.encode_ordinary(text) and bytes(row.decoded) == text.encode()
    assert bytebpe.encoded(spark.createDataFrame([], DOCS)).count() == 0


def test_long_texts_and_a_full_memory(monkeypatch, oracle):
    import public_tokenizers as p

    ranks, enc = oracle
    monkeypatch.setattr(bytebpe, "PIECE_CHARS", 40)
    monkeypatch.setattr(bytebpe, "CACHE_WORDS", 20)
    monkeypatch.setattr(bytebpe, "CACHE_CHARS", 4)
    codec = bytebpe.ByteBPE(ranks, p.PATTERN)
    r = random.Random(8)
    for _ in range(300):
        texts = ["".join(r.choice("abcde  \nxyz1é🙂") for _ in range(r.randint(0, 120))) for _ in range(r.randint(1, 4))]
        assert [np.frombuffer(x, "<i4").tolist() for x in codec.encode(texts)] == [enc.encode_ordinary(t) for t in texts]


def test_decoding_of_what_is_no_id(spark):
    rows = [(1, [64, 65]), (2, None), (3, []), (4, [64, None]), (5, [-1]), (6, [10**6])]
    got = {r.i: r.decoded for r in bytebpe.decoded(spark.createDataFrame(rows, "i int, ids array<int>")).collect()}
    assert got[1] is not None and bytes(got[3]) == b"" and all(got[i] is None for i in (2, 4, 5, 6))


def test_ranks_must_be_whole():
    with pytest.raises(ValueError):
        bytebpe.bpe_model({bytes([b]): b for b in range(255)})


def test_byte_bpe_query(spark, oracle):
    _, enc = oracle
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op13_byte_bpe"](spark, SF).collect():
        ids = enc.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest())


def test_whitening_query(spark):
    got = QUERIES["op11_embedding_whitening"](spark, SF).toPandas()
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    rows, n, deviation, white, explained = brute_whitening(vectors)
    assert len(got) == 8 * n and got.identity_error.max() < 1e-9
    want = {i: d for (i, _), d in zip(rows, deviation)}
    assert all(want[i] == d for i, d in zip(got.vec_id, got.deviation))
    one = got[got.vec_id == rows[0][0]].sort_values("component")
    np.testing.assert_allclose(one.whitened.abs(), np.abs(white[0, :8]), rtol=1e-6)
    np.testing.assert_allclose(one.explained, explained[:8], rtol=1e-10)


@pytest.mark.parametrize("last", ["suffix", "unsure", "none"])
def test_small_latin_words_go_many_at_a_time(monkeypatch, last):
    plain = __import__("tokenizers").Tokenizer.from_file(tokenfiles.word_bpe_file())
    monkeypatch.setattr(tokenfiles, "_ASKED", 7)
    enc = tokenfiles.WordEncoder(tokenfiles.word_bpe_file())
    enc.last = {"suffix": enc.last, "unsure": np.zeros_like(enc.last), "none": None}[last]
    asked: list[str] = []

    class Seen:
        def encode_batch_fast(self, words, **kw):
            asked.extend(words)
            return plain.encode_batch_fast(words, **kw)

    enc.tokenizer = Seen()
    r = random.Random(3)
    small = [*map(chr, range(97, 123)), *(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)]
    texts = [" ".join("".join(r.choices(small, k=r.randint(1, 12))) + r.choice(["", "", ",", "!!", "_"]) for _ in range(40)) for _ in range(20)]
    odd = ["Été, ÜBER; ÿ", "ét don't a<b </w> x</w> x_ _, _", "naïve!! ﬁne ªº 日本 ½ a×b ÷ µ, ſ", "", None, "…", " \t\n", "á, ȩ́.", " a­b \u0085c"]
    every = texts + odd + texts[:3]
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in every]
    assert [np.frombuffer(x, enc.kind).tolist() for x in enc.encode(every[:15]) + enc.encode(every[15:])] == want
    assert asked and not [w for w in asked if set(w) <= set(small)]


def test_a_worker_keeps_its_encoder_for_later_tasks(spark):
    docs = spark.range(40).selectExpr("id AS doc_id", "'a b' AS text")
    tokenfiles.write_shards(docs, tokenfiles.word_bpe_file(), common.fresh_path(spark, "t"))

    def kept(batches):
        from kmerlake.llm import tokenfiles as own

        for batch in batches:
            yield batch.select([0]).set_column(0, "n", np.full(batch.num_rows, len(own._ENCODERS)))

    assert spark.range(0, 64, 1, 16).mapInArrow(kept, "n long").agg(F.max("n")).first()[0] == 1
