"""Each operator against brute force or a round trip, on small tables and on the awkward ones."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from kmerlake.llm import common, decontaminate, langid, linededup, mixing, quality, setjoin, simhash, spotsigs, suffixdedup, tokencount, tokenfiles
from kmerlake.llm.components import connected_components
from kmerlake.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, root string, key double, at int, h long, bits long, a long, b long, _bucket int"
EXTRA = ("x", 0.5, 1, 2, 3, 4, 5, 6)
LONG = " ".join(f"word{i * i % 977}" for i in range(30_000))


def rows(*pairs):
    return [(i, t, "en", s, len(t or ""), *EXTRA) for i, t, s in pairs]


def awkward(spark):
    return spark.createDataFrame(
        rows((5, None, "b"), (1, "", None), (2, "   \n\t", "a"), (3, "the cat sat on the mat and the dog ran to the cat", "a"), (3, "the cat sat on the mat and the dog ran to the cat", "a"), (None, "the cat sat on the mat and the dog ran to the cat", "b"), (9, LONG, "b"), (7, "Ünï cödé ß ¡hola! 你好 世界 🙂", None)),
        SCHEMA,
    )


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sf(spark, name="documents"):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run_and_agree_with_sql(spark, name):
    import duckdb

    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLE_SQL:
        assert len(got) == 200
        return
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.sql(ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    got, want = (x[cols].sort_values(["doc_id", *(c for c in cols if c == "item_id")]).reset_index(drop=True) for x in (got, want))
    for c in cols:
        if got[c].dtype.kind == "f":
            np.testing.assert_allclose(got[c], want[c], rtol=1e-12)
        else:
            assert (got[c] == want[c]).all(), c


# common


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    raw = (LONG + " end").encode()
    whole = common.hashed_words(raw)
    monkeypatch.setattr(common, "PIECE", 1000)
    monkeypatch.setattr(common, "_POWERS", {})
    for a, b in zip(whole, common.hashed_words(raw)):
        assert (a == b).all()
    assert [raw[s:e] for s, e in zip(whole[1], whole[2])] == raw.split()


def test_components_by_brute_force(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(200 + i, 201 + i) for i in range(40)]
    root = {x: x for p in pairs for x in p}
    for _ in range(300):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = dict(connected_components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert got == {x: r for x, r in root.items() if x != r or x in got} and all(root[x] == r for x, r in got.items())
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1 language ID


def test_language_held_out_accuracy(spark):
    docs = sf(spark)
    got = QUERIES["op1_language_id"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95
    assert got.where("score < 0 or score > 1").count() == 0
    crc = {r["doc_id"]: r["held_out"] for r in got.collect()}
    assert all(v == (zlib.crc32(str(k).encode()) % 3 == 1) for k, v in crc.items())


def test_language_awkward(spark):
    model = langid.fit(sf(spark))
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.predict(awkward(spark), model).collect()}
    assert {(5, "und"), (1, "und"), (2, "und")} <= got and langid.predict(awkward(spark), model).count() == 8
    assert langid.predict(empty(spark), model).count() == 0
    none = langid.fit(empty(spark))
    assert {r["lang_pred"] for r in langid.predict(awkward(spark), none).collect()} == {"und"}
    assert model.predict("12 34 !!")[0] == "und" and model.predict("xqzjk wvxq zzxq")[2]


def test_radius_is_of_the_rows_nearest_to_a_centroid(spark):
    kinds = ("abab baba abba", "xyxy yxyx yxxy", "mnmn nmnm nmmn", "qrqr rqrq rqqr")
    docs = spark.createDataFrame([(i, f"{kinds[i % 4]} {kinds[i % 4][: 2 + i % 5]}", "en") for i in range(200)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert len(model.radius) == 4 and (model.radius < 0.5).all()
    assert model.predict("abab xyxy mnmn qrqr")[2] and not model.predict(kinds[0])[2]


# 2 token counts


def brute_tokens(model, word):
    best = [(0.0, 0)]
    text = tokencount.MARK + word
    for i in range(len(text)):
        n = len(text[i].encode())
        options = [(best[i][0] + n * model.byte_score, best[i][1] - n)]
        for s in range(i + 1):
            p = model.score.get(text[s : i + 1])
            if p is not None:
                options.append((best[s][0] + p, best[s][1] - 1))
        best.append(max(options))
    return -best[-1][1]


def test_token_counts_by_brute_force(spark):
    import public_tokenizers

    model = tokencount.Unigram.from_file(public_tokenizers.path("piece_bpe_32k.model"))
    words = ["the", "theater", "thesis", "", "ünïcode", "你好世界", "xqzjkwv", "a" * 60, "▁", "▁the"]
    trie = tokencount.ScoreTrie(model)
    assert [trie.count(w) for w in words] == [brute_tokens(model, w) for w in words]
    got = {(r["doc_id"], r["n_words"]): r["n_tokens"] for r in tokencount.token_counts(awkward(spark)).collect()}
    assert got[(5, 0)] == got[(1, 0)] == got[(2, 0)] == 0
    assert got[(9, 30_000)] == sum(trie.count(w) for w in LONG.split())
    assert tokencount.token_counts(empty(spark)).count() == 0


# 3 SimHash


def brute_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_by_brute_force(spark):
    docs = awkward(spark).collect() + sf(spark).limit(60).withColumn("doc_id", F.col("doc_id") + 100).collect()
    for d in docs:
        assert simhash.text_fingerprint(d["text"]) == brute_fingerprint(d["text"])
    got = {r["doc_id"]: r for r in simhash.near_duplicates(awkward(spark)).collect()}
    assert got[5]["fingerprint"] == "0" * 16 and got[5]["component_id"] == got[1]["component_id"] == got[2]["component_id"] == 1
    assert got[3]["component_id"] == got[None]["component_id"] == 3 and got[9]["component_id"] == 9
    assert simhash.near_duplicates(awkward(spark)).count() == 8 and simhash.near_duplicates(empty(spark)).count() == 0
    native = spark.createDataFrame([("a b c",)], "t string").select(F.xxhash64("t")).first()[0]
    assert native % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("radius", [1, 3, 4])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    f = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    for i in range(60, 150):
        f[i] = f[rng.integers(0, i)] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, 4).astype(np.uint64))
    got = simhash.block_links(f, radius)
    want = np.arange(150)
    for _ in range(150):
        for i, j in itertools.combinations(range(150), 2):
            if int(f[i] ^ f[j]).bit_count() <= radius:
                want[i] = want[j] = min(want[i], want[j])
        if (want == want[want]).all():
            break
    assert (got == want).all()


@pytest.mark.parametrize("n", [10, 1 << 21, 1 << 35])
def test_masks_miss_no_link(n):
    masks = [m % (1 << 64) for m in simhash.table_masks(n)]
    rng = np.random.default_rng(0)
    for _ in range(300):
        x = 0
        for b in rng.choice(64, 3, replace=False):
            x |= 1 << int(b)
        assert any(x & m == 0 for m in masks)


def test_hot_buckets_are_tiled(spark):
    base = 0x0123456789ABCDEF
    fps = sorted({base ^ (1 << a) ^ (1 << b) for a in range(24) for b in range(a)})
    edges = simhash.near_edges(spark.createDataFrame([(f,) for f in fps], "fp long"), simhash.table_masks(len(fps)), tile=32)
    assert connected_components(edges).select("root").distinct().count() == 1
    assert edges.count() < 40 * len(fps)


def test_one_document_of_each_group_stays(spark):
    docs = awkward(spark)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [1, 3, 7, 9]


def test_groups_without_an_id_keep_one_row(spark):
    beside, alone, other = "the cat sat on the mat and ran", " ".join(f"alone{i}" for i in range(300)), "a text that no row shares"
    near = f"{alone} x"
    assert (brute_fingerprint(alone) ^ brute_fingerprint(near)).bit_count() in (1, 2, 3)
    docs = spark.createDataFrame(rows((4, beside, "a"), (None, beside, "b"), *((None, alone, s) for s in "aab"), (None, near, "b"), (None, other, None)), SCHEMA)
    kept = [(r["doc_id"], r["text"]) for r in simhash.one_of_each(docs).collect()]
    assert len(kept) == 3 and {(4, beside), (None, other)} < set(kept) and {t for _, t in kept} & {alone, near}


# 4 decontamination


def brute_contained(docs, items):
    def grams(t):
        w = re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").lower().encode())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    own = {i: grams(t) for i, t in items}
    return {(d, i) for d, t in docs for g in [grams(t)] for i, s in own.items() if s and len(s & g) >= 0.8 * len(s)}


def test_decontamination_by_brute_force(spark):
    docs, items = sf(spark), sf(spark, "benchmark")
    items_ = [(r["item_id"], r["text"]) for r in items.collect()]
    long = LONG + " " + items_[0][1] + " " + LONG
    more = spark.createDataFrame(rows((1000, long, "a"), (1001, "Prefix, " + items_[1][1].upper().replace(" ", " - "), "a"), (None, items_[2][1], "b")), SCHEMA)
    every = docs.unionByName(more.select(docs.columns))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(every, items).collect()}
    assert got == brute_contained([(r["doc_id"], r["text"]) for r in every.collect()], items_) and (1000, items_[0][0]) in got and (None, items_[2][0]) in got
    clean = {r["doc_id"] for r in decontaminate.clean(every, items).collect()}
    assert clean == {r["doc_id"] for r in every.collect()} - {d for d, _ in got}


def test_decontamination_awkward(spark):
    items = spark.createDataFrame([(1, None), (2, "too short"), (None, "the cat sat on the mat and"), (4, "")], "item_id long, text string")
    got = decontaminate.contaminated(awkward(spark), items).collect()
    assert sorted((r["doc_id"] or -1, r["item_id"]) for r in got) == [(-1, None), (3, None), (3, None)]
    assert decontaminate.contaminated(empty(spark), items).count() == 0
    assert decontaminate.clean(awkward(spark), items.limit(0)).count() == 8


# 5 document fingerprints


def test_spotsigs_awkward(spark):
    got = spotsigs.edited_fingerprints(awkward(spark)).collect()
    assert len(got) == 8
    by = {r["doc_id"]: r for r in got}
    assert by[5]["n_chars"] == 0 and by[5]["edited_sha256"] == hashlib.sha256(b"").hexdigest() and by[5]["near_edited"] == 1.0
    assert by[3]["fingerprint"] == by[None]["fingerprint"] and by[1]["fingerprint"] == by[5]["fingerprint"]
    t7, t5 = "Ünï cödé ß ¡hola! 你好 世界 🙂", ""
    assert by[7]["n_chars"] == len(t7) and by[7]["edited_sha256"] == hashlib.sha256((t7[: len(t7) - len(t7) // 2] + t5).encode()).hexdigest()
    assert spotsigs.edited_fingerprints(empty(spark)).count() == 0


def test_next_document_over_many_buckets(spark):
    docs = spark.createDataFrame([(i * i % 1009 * 7, f"text {i}") for i in range(400)], "doc_id long, text string").dropDuplicates(["doc_id"])
    bucketed, window, extra = spotsigs.with_next(docs, rows=13)
    got = dict(bucketed.withColumn("n", F.lead("text").over(window)).where(~F.col(extra)).select("doc_id", "n").collect())
    order = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), reverse=True)
    assert got == {order[i][0]: order[(i + 1) % len(order)][1] for i in range(len(order))}


def test_spotsigs_pairs(spark):
    base = "the quick brown fox of lazy dog to green river and old stone in white house for long road with red gate by blue lake on high hill at dark wood "
    docs = spark.createDataFrame(rows((1, base, "a"), (2, base + "the extra word", "a"), (3, base, "a"), (4, "der alte mann und das meer in der nacht", "a")), SCHEMA)
    pairs, members = spotsigs.near_pairs(docs, least=0.7)
    own = dict(members.select("doc_id", "fingerprint").collect())
    assert {frozenset((r["a"], r["b"])) for r in pairs.collect()} == {frozenset((own[1], own[2]))} and own[1] == own[3]


# 6 mixing


def test_mixing_targets(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 10), ("c", 1000), ("d", 0), (None, 50)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    weight, cap = {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}, {"a": 300, "b": 30, "c": 3000, "d": 0, None: 150}
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(cap[s], mid * weight[s]) for s in cap) < 1160 else (lo, mid)
    assert all(abs(got[s] - min(cap[s], lo * weight[s])) < 1e-6 for s in cap)


def test_mixing_whole_table(spark):
    got = QUERIES["op6_source_mixing"](spark, SF).join(sf(spark).select("doc_id", "source"), "doc_id").toPandas()
    assert (got.taken % got["size"].clip(lower=1) == 0).all() and (got.taken <= 3 * got["size"]).all()
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), most=("size", "max"))
    assert ((by.taken - by.target).abs() <= by.most).all()
    assert got.equals(QUERIES["op6_source_mixing"](spark, SF).join(sf(spark).select("doc_id", "source"), "doc_id").toPandas().set_index("doc_id").loc[got.doc_id].reset_index()[got.columns])


def test_mixing_awkward(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 2)
    got = mixing.mix(awkward(spark)).collect()
    assert len(got) == 8 and all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixed(awkward(spark)).columns == awkward(spark).columns


def test_mixed_takes_the_words_of_mix_for_shared_and_null_ids(spark):
    def text(i):
        return " ".join(f"w{i * j % 89}" for j in range(1, 2 + i % 7))

    docs = spark.createDataFrame(
        rows(
            *((None, text(i), "a") for i in range(9)),
            *((None, text(i + 3), "b") for i in range(60)),
            *((i % 3, text(i), "c") for i in range(90)),
            *((None, "the same row many times", "c") for _ in range(90)),
            *((7, text(i), None) for i in range(20)),
        ),
        SCHEMA,
    )
    decided = mixing.mix(docs)
    assert decided.where("copies % 2 = 1").count() and decided.groupBy("source", "size").agg(F.countDistinct("copies").alias("n")).where("n > 1").count()
    got = mixing.mixed(docs).withColumn("size", mixing.words_in(F.col("text")))
    for by in (["source"], ["source", "doc_id", "size"]):
        taken = {tuple(r)[:-1]: r["words"] for r in decided.groupBy(*by).agg(F.sum("taken").alias("words")).collect() if r["words"]}
        assert {tuple(r)[:-1]: r["words"] for r in got.groupBy(*by).agg(F.sum("size").alias("words")).collect()} == taken
    assert got.where("text = 'the same row many times'").count() % 90


# 7 quality


def test_quality_held_out(spark):
    got = QUERIES["op7_quality_classifier"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").toPandas()
    good, bad = got[got.quality == 1].score.values, got[got.quality == 0].score.values
    assert (good[:, None] > bad[None, :]).mean() > 0.95 and ((got.predicted == got.quality).mean()) > 0.9


def test_factorisation_identity_and_awkward(spark):
    model = quality.fit_documents(spark, sf(spark), SF)
    at, v = quality.features("The cat sat !!! on\nthe mat", model.slots)
    x = model.standard(v)
    pairs = sum(float(model.factor[at[i]] @ model.factor[at[j]]) * x[i] * x[j] for i, j in itertools.combinations(range(len(at)), 2))
    z = model.bias + model.weight[at] @ x + pairs
    assert abs(model.score("The cat sat !!! on\nthe mat") - 1 / (1 + np.exp(-z))) < 1e-9
    got = quality.scores(awkward(spark), model).collect()
    assert len(got) == 8 and all(0 <= r["score"] <= 1 for r in got) and quality.scores(empty(spark), model).count() == 0
    none = quality.fit(empty(spark), spark.createDataFrame([], "doc_id long, quality int"))
    assert none.score("anything") == 0.5 and quality.accepted(awkward(spark), none).columns == awkward(spark).columns


# 8 token files


def test_perfect_hash():
    keys = common.mix64(np.arange(5000, dtype=np.uint64))
    h = tokenfiles.PerfectHash.build(keys)
    assert sorted(h.seats(keys).tolist()) == list(range(5000))
    assert tokenfiles.PerfectHash.build(keys[:0]).seats(keys[:3]).tolist() == [-1] * 3


def test_token_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenfiles.word_bpe_file())
    odd = spark.createDataFrame(rows((8, "It's <|endoftext|> A\x1cb C Ḱ İΣ 12ab,x!! _under_score", "a"), (10, "<|STARTOFTEXT|>", "a")), SCHEMA)
    docs = awkward(spark).unionByName(odd)
    manifest = tokenfiles.write_shards(docs, tokenfiles.word_bpe_file(), common.fresh_path(spark, "t"))
    got = tokenfiles.read_shards(manifest).orderBy("start").collect()
    order = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    start = 0
    for r, d in zip(got, order, strict=True):
        ids = [*t.encode(d["text"] or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert [r["nth"] for r in got if r["doc_id"] == 3] == [0, 1]
    found = dict(tokenfiles.lookup(manifest, spark.createDataFrame([(8,), (77,), (7,)], "doc_id long")).collect())
    assert set(found) == {7, 8} and found[8] == [*t.encode(odd.first()["text"], add_special_tokens=False).ids, 2]
    assert tokenfiles.encode_documents(empty(spark)).count() == 0


def test_lookup_over_many_shards(spark):
    docs = spark.range(400).selectExpr("id * 3 as doc_id", "concat('text ', id) as text").union(spark.sql("select cast(null as long), 'none'"))
    manifest = tokenfiles.write_shards(docs, tokenfiles.word_bpe_file(), common.fresh_path(spark, "t"), shard_rows=20).cache()
    files = [r["file"] for r in manifest.where("docs > 0").collect()]
    assert len(files) > 10
    every = dict(tokenfiles.lookup(manifest, spark.range(-5, 1300).toDF("doc_id")).collect())
    assert tokenfiles.lookup(manifest, spark.sql("select cast(null as long) as doc_id")).count() == 1
    assert sorted(every) == [i * 3 for i in range(400)]
    t = __import__("tokenizers").Tokenizer.from_file(tokenfiles.word_bpe_file())
    assert all(ids == [*t.encode(f"text {i // 3}", add_special_tokens=False).ids, 2] for i, ids in every.items())


@pytest.mark.parametrize("shard_rows", [3, 20, 1000])
def test_rows_of_an_id_are_numbered_through_all_shards(spark, shard_rows):
    """Sixty rows of one id, twenty of none and a few others: every (doc_id, nth) is there once and found by it."""
    texts = [(7, f"seven {i % 9} x{i}") for i in range(60)] + [(None, f"none {i}") for i in range(20)] + [(i, f"other {i}") for i in (-(1 << 63), 1, 6, 8, 8, (1 << 63) - 1)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    manifest = tokenfiles.write_shards(docs, tokenfiles.word_bpe_file(), common.fresh_path(spark, "t"), shard_rows=shard_rows).cache()
    got = tokenfiles.read_shards(manifest).collect()
    keys = {(r["doc_id"], r["nth"]) for r in got}
    assert len(got) == len(texts) == len(keys)
    assert keys == {(7, i) for i in range(60)} | {(None, i) for i in range(20)} | {(8, 0), (8, 1), (1, 0), (6, 0), (-(1 << 63), 0), ((1 << 63) - 1, 0)}
    order = sorted(got, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["nth"]))
    assert [r["start"] for r in order] == sorted(r["start"] for r in got)
    wanted = spark.createDataFrame([*keys, (7, 60), (None, 20), (9, 0), (1, None), (8, -1)], "doc_id long, nth long")
    found = {(r["doc_id"], r["nth"]): zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in tokenfiles.lookup(manifest, wanted, nth_col="nth").collect()}
    assert found == {(r["doc_id"], r["nth"]): r["ids_crc32"] for r in got}
    first = {r["doc_id"]: zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in tokenfiles.lookup(manifest, wanted.select("doc_id")).collect()}
    assert first == {r["doc_id"]: r["ids_crc32"] for r in got if r["nth"] == 0}


def test_chance_fingerprint_gives_no_other_document(monkeypatch):
    import io

    monkeypatch.setattr(tokenfiles, "_print", lambda keys: np.zeros(len(keys), np.uint32))
    sink = io.BytesIO()
    writer = tokenfiles.ShardWriter(sink, np.dtype("<u2"))
    for i in range(500):
        writer.add(i, np.array([i, 2], "<u2").tobytes())
    writer.close()
    shard = tokenfiles.Shard(pa.BufferReader(sink.getvalue()))
    find = lambda keys: shard.find(keys, np.zeros(len(keys), np.uint8), np.zeros(len(keys), np.uint32))
    assert find(np.arange(500))[0].tolist() == list(range(0, 1000, 2))
    assert (shard.mph.seats(tokenfiles._key(np.arange(10_000, 11_000), np.zeros(1000, np.uint8), np.zeros(1000, np.uint8))) >= 0).any()
    assert (find(np.arange(10_000, 11_000))[0] == -1).all()


# 9 line dedup


def brute_lines(docs, least=80):
    lines = []
    for i, t in sorted(docs, key=lambda d: d[0]):
        for no, line in enumerate(t.split("\n") if t is not None else []):
            w = {x for x in line.lower().replace("\t", " ").replace("\r", " ").split(" ") if x}
            if w:
                lines.append((i, no, w))
    gone = set()
    for k, (i, no, w) in enumerate(lines):
        if any(100 * len(w & v) >= least * len(w | v) for _, _, v in lines[:k]):
            gone.add((i, no))
    return gone


@pytest.mark.parametrize("hot,block", [(1024, 1 << 17), (2, 1 << 17), (2, 4), (5, 1)])
def test_lines_by_brute_force(spark, monkeypatch, hot, block):
    monkeypatch.setattr(linededup, "HOT", hot)
    monkeypatch.setattr(linededup, "BLOCK", block)
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(40):
        lines = []
        for _ in range(4):
            n = int(rng.integers(1, 14))
            lines.append(" ".join(words[int(x)] for x in rng.integers(0, 12 if rng.random() < 0.4 else 60, n)))
        if docs and rng.random() < 0.5:
            old = docs[int(rng.integers(0, len(docs)))][1].split("\n")[0].split(" ")
            old[int(rng.integers(0, len(old)))] = "new"
            lines.append(" ".join(old))
        docs.append((i * 3, "\n".join(lines)))
    docs += [(500, ""), (501, None), (502, " \n\nw1 w2 w3 w4\n\n"), (503, "W1 w2 w3\tw4\r")]
    df = spark.createDataFrame(rows(*[(i, t, "a") for i, t in docs]), SCHEMA)
    got = {(r["doc_id"], r["no"]) for r in linededup.removed_lines(df).collect()}
    assert got == brute_lines(docs)
    kept = {r["doc_id"]: r["text"] for r in linededup.deduplicated(df).collect()}
    assert kept == {i: t if t is None or not any(d == i for d, _ in got) else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in got) for i, t in docs}


def test_lines_of_rows_that_share_an_id(spark):
    """Each row is a document of its own: unique lines stay, whatever the ids."""
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(30)]
    texts = ["\n".join(" ".join(words[int(x)] for x in rng.integers(0, 30, int(rng.integers(1, 9)))) for _ in range(3)) for _ in range(60)]
    docs = [(None if k % 3 == 0 else k % 5, t) for k, t in enumerate(texts)]
    docs += [(1, "q w e r t"), (5, "unique text here now"), (5, "q w e r t"), (None, "all fresh words here\nsecond fresh line"), (None, "x y\nq w e r t"), (None, None), (None, ""), *[(7, "seven seven\nalone in seven")] * 5, *[(None, "null null\nalone in null")] * 5]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(docs)], "doc_id long, text string, _row int").repartition(7)
    out = linededup.deduplicated(df).collect()
    assert sorted(r["_row"] for r in out) == list(range(len(docs)))
    got = {r["_row"]: r["text"] for r in out}
    numbers = {}
    for r in linededup.numbered(df.withColumnRenamed("_row", "k"), F.col("doc_id"), F.col("text")).collect():
        numbers.setdefault((r["_doc"], r["text"]), []).append(r["_row"])
    for (i, _t), own in numbers.items():
        assert len(set(own)) == len(own), i
    by_id = {}
    for (i, _t), own in numbers.items():
        by_id.setdefault(i, []).extend(own)
    assert all(sorted(v) == list(range(len(v))) for v in by_id.values())
    lines, want = [], {}
    keyed = sorted((linededup._FIRST_ID if i is None else i, n, t) for (i, t), own in numbers.items() if t is not None for n in own)
    for i, n, t in keyed:
        stay = []
        for line in t.split("\n"):
            w = set(line.lower().split())
            if not w or not any(100 * len(w & v) >= 80 * len(w | v) for v in lines):
                stay.append(line)
            if w:
                lines.append(w)
        want.setdefault((i, t), []).append("\n".join(stay) if len(stay) < len(t.split("\n")) else t)
    found = {}
    for k, (i, t) in enumerate(docs):
        if t is not None:
            found.setdefault((linededup._FIRST_ID if i is None else i, t), []).append(got[k])
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    assert got[len(texts) + 1] == "unique text here now" and got[len(texts) + 3] == "all fresh words here\nsecond fresh line"
    report = linededup.line_report(df).collect()
    assert len(report) == len(docs) and sum(r["n_removed"] for r in report) == linededup.removed_lines(df).count()


def test_line_report_shuffles_no_text(spark):
    df = spark.createDataFrame(rows((1, "q w e r t\nq w e r t", "a"), (2, "q w e r t y\nx", "a"), (3, None, "a")), SCHEMA)
    made = linededup.line_report(df)
    plan = spark._jvm.PythonSQLUtils.explainString(made._jdf.queryExecution(), "formatted")
    exchanged = [part for part in plan.split("\n\n") if re.match(r"\s*\(\d+\) Exchange", part)]
    assert exchanged and not any(re.search(r"\bt#\d+", part) for part in exchanged)
    assert {r["doc_id"]: (r["n_lines"], r["removed"]) for r in made.collect()} == {1: (2, "1"), 2: (2, "0"), 3: (0, "")}


def test_lines_awkward(spark):
    got = linededup.line_report(awkward(spark)).collect()
    assert len(got) == 8 and {r["n_lines"] for r in got if r["doc_id"] == 5} == {0}
    assert linededup.line_report(empty(spark)).count() == 0


def test_similar_pairs_by_brute_force(spark):
    rng = np.random.default_rng(5)
    sets = [(i, sorted({int(x) for x in rng.integers(0, 25, int(rng.integers(1, 12)))})) for i in range(120)]
    got = {(r["a"], r["b"]) for r in setjoin.similar_pairs(spark.createDataFrame([(i, s) for i, s in sets], "id long, tokens array<long>"), 0.6).collect()}
    want = {(i, j) for (i, a), (j, b) in itertools.combinations(sets, 2) if len(set(a) & set(b)) * 100 >= 60 * len(set(a) | set(b))}
    assert {p for p in got if sets[p[0]][1] != sets[p[1]][1]} == {p for p in want if sets[p[0]][1] != sets[p[1]][1]}


# 10 suffix dedup


def brute_repeats(texts, n=400):
    raws = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for r in raws:
        for p in range(len(r) - n + 1):
            seen[r[p : p + n]] = seen.get(r[p : p + n], 0) + 1
    out = []
    for r in raws:
        cov = np.zeros(len(r) + 1, np.int64)
        for p in range(len(r) - n + 1):
            if seen[r[p : p + n]] > 1:
                cov[p] += 1
                cov[min(len(r), p + n)] -= 1
        c = np.cumsum(cov)[:-1] > 0 if len(r) else np.zeros(0, bool)
        kept = bytes(np.frombuffer(r, np.uint8)[~c]) if len(r) else b""
        out.append((len(r), int(c.sum()), int(np.count_nonzero(np.diff(np.concatenate(([0], c.astype(int)))) == 1)), kept))
    return out


@pytest.mark.parametrize("group", [1000, 1])
def test_suffix_dedup_by_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(suffixdedup, "GROUP", group)
    monkeypatch.setattr(suffixdedup, "PIECE", 700)
    rng = np.random.default_rng(4)
    some = lambda n: "".join(rng.choice(list("abcdefgh ü"), n))
    passage, edge = some(900), some(402)
    texts = [
        some(300) + passage + some(200), passage[100:800] + some(500), some(50) + passage[450:] + some(50) + passage[:420], some(2000), edge + some(5), some(5) + edge[1:], edge[:399], "ab" * 600, "x" * 1000,
        None, "", "x" * 399, some(10) + "line of text\n" * 60, "line of text\n" * 40, passage[:399] + "!", passage[:400] + "?",
    ]
    texts += [texts[3]]
    df = spark.createDataFrame(rows(*[(i, t, "a") for i, t in enumerate(texts)], ), SCHEMA)
    got = sorted(suffixdedup.remove_repeats(df).collect())
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got] == brute_repeats(texts)


def test_suffix_dedup_awkward(spark):
    got = suffixdedup.remove_repeats(awkward(spark).unionByName(awkward(spark).where("doc_id = 9"))).collect()
    assert len(got) == 9 and all(r["n_removed"] == r["n_bytes"] for r in got if r["doc_id"] == 9)
    assert suffixdedup.remove_repeats(empty(spark)).count() == 0


def test_shared_passages_and_repeated_rows(spark):
    rng = np.random.default_rng(8)
    some = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    passage = some(suffixdedup.PASSAGE)
    texts = [some(700) + passage + some(90), passage + some(50), some(900), some(300) + passage[: suffixdedup.GRAM - 1] + some(300), passage]
    df = spark.createDataFrame(rows(*[(i, t, "a") for i, t in enumerate(texts)]), SCHEMA)
    got = {r["doc_id"]: r for r in suffixdedup.remove_repeats(df).collect()}
    assert [got[i]["n_shared"] > 0 for i in range(5)] == [True, True, False, False, True] and not any(r["n_removed"] for r in got.values())
    long = some(1500)
    many = spark.createDataFrame(rows(*[(None, long, "a")] * 400, (1, some(200) + long[300:1100], "a")), SCHEMA)
    got = suffixdedup.remove_repeats(many).collect()
    assert len(got) == 401 and all(r["n_removed"] == 1500 for r in got if r["doc_id"] is None) and [r["n_removed"] for r in got if r["doc_id"] == 1] == [800]


@pytest.mark.parametrize("step", [mixing.mixed, simhash.one_of_each, linededup.deduplicated])
def test_any_column_names_and_types(spark, step):
    names = ["_hash", "_copies", "_copy", "_taken", "_doc", "_gone", "_h", "_row", "_again", "c0", "c1"]
    df = awkward(spark).withColumns({n: F.lit(n) for n in names}).withColumn("tags", F.create_map(F.lit("a"), F.lit(1)))
    got = step(df)
    assert got.columns == df.columns and all(r[n] == n for r in got.collect() for n in names)
    assert step(empty(spark)).count() == 0 and step(empty(spark)).columns == empty(spark).columns


def test_deep_shallow_order():
    rng = np.random.default_rng(2)
    s = ["".join(rng.choice(list("ab"), int(rng.integers(0, 60)))).encode() for _ in range(200)]
    s += [b"a" * 50 + x for x in s[:60]] + s[:20]
    order, lcp = suffixdedup.deep_shallow(s)
    assert [s[i] for i in order] == sorted(s) and sorted(order) == list(range(len(s)))
    for k in range(1, len(s)):
        a, b = s[order[k - 1]], s[order[k]]
        assert lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


# pipeline


def test_pipeline_by_brute_force(spark):
    import corpus_pipeline as c

    docs = sf(spark)
    for _, stage in c.STAGES[:-1]:
        path = common.fresh_path(spark, "test")
        stage(spark, docs, SF).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        assert docs.columns == before.columns
        if stage is c.keep_quality:
            model = quality.fit_documents(spark, before, SF)
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in before.collect() if model.score(r["text"]) >= quality.CUTOFF}
        elif stage is c.drop_near_copies:
            fps = {r["doc_id"]: brute_fingerprint(r["text"]) for r in before.collect()}
            root = {i: i for i in fps}
            for _ in range(5):
                for i, j in itertools.combinations(sorted(fps), 2):
                    if (fps[i] ^ fps[j]).bit_count() <= 3:
                        root[i] = root[j] = min(root[i], root[j])
            assert {r["doc_id"] for r in docs.collect()} == {i for i in fps if root[i] == i}
        elif stage is c.drop_contaminated:
            hit = brute_contained([(r["doc_id"], r["text"]) for r in before.collect()], [(r["item_id"], r["text"]) for r in sf(spark, "benchmark").collect()])
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in before.collect()} - {d for d, _ in hit}
        else:
            taken = {r["doc_id"]: r["copies"] for r in mixing.mix(before).collect()}
            assert {r["doc_id"]: r["count"] for r in docs.groupBy("doc_id").count().collect()} == {i: n for i, n in taken.items() if n}
    out = c.STAGES[-1][1](spark, docs, SF).count()
    assert out == docs.count() == c.run(spark, SF).count()
