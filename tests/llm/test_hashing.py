"""SimHash, Order MinHash and byte-level BPE against plain versions."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from scourline.llm import bpe, orderminhash, queries, simhash
from tests.llm.conftest import ODD

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    found = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    counts = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in found) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(found))


def brute_components(fps):
    """id -> least id reachable over links of 3 bits at most."""
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in fps:
        for b in fps:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in fps}


def test_simhash_of_odd_texts(odd):
    got = {r["doc_id"]: r for r in simhash.components(simhash.fingerprints(odd)).collect()}
    fps = {i: brute_fingerprint(t) for i, t in enumerate(ODD)}
    assert {i: r["fp"] & (1 << 64) - 1 for i, r in got.items()} == fps
    assert {i: r["component_id"] for i, r in got.items()} == brute_components(fps)


@pytest.mark.parametrize("crowd", [simhash.CROWD, 3])
def test_simhash_components(spark, crowd):
    rng = random.Random(4)
    base = rng.getrandbits(64)
    fps = [base]
    for _ in range(60):  # a cloud whose links chain
        fps.append(rng.choice(fps) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    fps += [rng.getrandbits(64) for _ in range(40)] + [base, base]
    df = spark.createDataFrame([(i, int(np.uint64(f).astype(np.int64))) for i, f in enumerate(fps)], "doc_id bigint, fp bigint")
    got = {r["doc_id"]: r["component_id"] for r in simhash.components(df, crowd=crowd).collect()}
    assert got == brute_components(dict(enumerate(fps)))


def test_simhash_query(spark):
    out = queries.QUERIES["op9_simhash"](spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    fps = {r["doc_id"]: brute_fingerprint(r["text"]) for r in docs}
    assert {r["doc_id"]: r["fingerprint"] for r in out} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {r["doc_id"]: r["component_id"] for r in out} == brute_components(fps)


def test_simhash_without_rows_and_ids(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash.components(simhash.fingerprints(none)).count() == 0 and simhash.deduplicate(none).count() == 0
    df = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (7, "a b c"), (7, "a b c"), (9, "d e f g")], "doc_id bigint, text string")
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in simhash.components(simhash.fingerprints(df)).collect()) == [(-1, 7), (-1, 7), (7, 7), (7, 7), (9, 9)]
    assert sorted(r["doc_id"] or -1 for r in simhash.deduplicate(df).collect()) == [-1, -1, 7, 9]


def test_similar_documents(spark, make):
    rng = random.Random(8)
    texts = [prose(rng, 300) for _ in range(30)]
    near = []
    for t in texts[:10]:  # one word in a hundred changes: similarity about 0.9
        words = t.split()
        for at in (50, 150, 250):
            words[at] = "changed"
        near.append(" ".join(words))
    far = [" ".join(t.split()[:150]) + " " + prose(rng, 150) for t in texts[10:20]]  # similarity about 1/3
    df = make(texts + near + far + texts[:3])
    kept = {r["doc_id"] for r in simhash.deduplicate(df).collect()}
    assert kept == set(range(30)) | set(range(40, 50))
    assert simhash.deduplicate(df).columns == df.columns
    assert simhash.deduplicate(make(ODD)).count() == 8  # null, empty and blank are one, the two equal texts too


def brute_groups(texts, least=0.8):
    sets = [set(simhash.shingles(t.encode()).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i for i in range(len(texts)) if find(i) == i}


def changed(rng, words, n):
    """Each of n words, far enough apart, takes five shingles."""
    out = list(words)
    for at in rng.sample(range(5, len(words) - 5, 6), n):
        out[at] = f"w{rng.getrandbits(40)}"
    return out


def test_near_copies_within_a_family_of_looser_texts(spark, make):
    rng = random.Random(12)
    base = [f"b{rng.getrandbits(40)}" for _ in range(400)]
    family = [changed(rng, base, 8) for _ in range(60)]  # similarity about 0.7 among themselves
    copies = [changed(rng, t, 7) for t in family[:30]]  # about 0.84 to one of them
    texts = [" ".join(t) for t in family + copies]
    want = brute_groups(texts)
    assert 50 <= len(want) <= 70
    assert {r["doc_id"] for r in simhash.deduplicate(make(texts)).collect()} == want


def test_short_similar_texts_are_all_found(spark, make):
    rng = random.Random(13)
    texts = []
    for n in (8, 9, 13, 16, 20, 32, 64, 68):  # n and n - 4 shingles at a similarity of 0.8 or little more
        for _ in range(15):
            words = [f"b{rng.getrandbits(40)}" for _ in range(n)]
            texts += [" ".join(words), " ".join([*words, *(f"c{rng.getrandbits(40)}" for _ in range((n - 4) // 4))])]
    assert {r["doc_id"] for r in simhash.deduplicate(make(texts)).collect()} == brute_groups(texts) == set(range(0, len(texts), 2))


def test_hot_fingerprints_are_looked_up(spark, monkeypatch):
    rng = random.Random(2)
    left = spark.createDataFrame([(rng.choice([1, 1, 1, 2, 3]), i) for i in range(50)], "k bigint, i bigint")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("m"))
    want = sorted(map(tuple, left.join(right.drop("n"), "k").select("k", "i", "m").collect()))
    for hot in (1, 12, 100):
        assert sorted(map(tuple, simhash.looked_up(left, right, "k", hot).select("k", "i", "m").collect())) == want


@pytest.mark.parametrize("templates, each, least, most, crowd", [(1, 400, 5, 9, simhash.CROWD), (1, 400, 5, 9, 40), (2, 250, 4, 9, simhash.CROWD), (4, 120, 3, 8, simhash.CROWD)])
def test_near_copies_among_documents_of_one_template(spark, make, templates, each, least, most, crowd):
    """With crowd 40, most of the templates' blocks are crowded and go by parts."""
    rng = random.Random(templates)
    texts = []
    for _ in range(templates):
        base = [f"b{rng.getrandbits(40)}" for _ in range(400)]
        texts += [" ".join(changed(rng, base, rng.randint(least, most))) for _ in range(each)]
    want = brute_groups(texts)
    got = {r["doc_id"] for r in simhash.deduplicate(make(texts), crowd=crowd).collect()}
    assert got >= want  # no document goes that brute force keeps
    assert len(texts) - len(got) >= 0.98 * (len(texts) - len(want))


@pytest.mark.parametrize("crowd, rows", [(simhash.CROWD, 1), (100, 64)])
def test_rows_of_a_group_grow_no_faster_than_its_members(spark, make, monkeypatch, crowd, rows):
    """Members that meet in many blocks are compared once; a group too large for that has a row for each block at most."""
    rng = random.Random(31)
    base = [f"b{rng.getrandbits(40)}" for _ in range(400)]
    texts = [" ".join(changed(rng, base, rng.randint(3, 9))) for _ in range(200)]
    dealt, in_order = [], simhash._in_order
    monkeypatch.setattr(simhash, "_in_order", lambda df, key: (dealt.append((key, df)), in_order(df, key))[1])
    got = {}
    for n in (100, 200):
        dealt.clear()
        got[n] = {r["doc_id"] for r in simhash.deduplicate(make(texts[:n]), crowd=crowd).collect()}
        assert got[n] == brute_groups(texts[:n])
        made = {key: df.count() for key, df in dealt if key == "family" or (key == "run" and crowd > n)}
        assert 0 < made["family"] <= rows * n and made.get("run", 0) <= n


def test_near_copies_of_pairs(spark, make):
    rng = random.Random(21)
    texts = []
    for n in (120, 250, 400):
        for _ in range(60):
            words = [f"b{rng.getrandbits(40)}" for _ in range(n)]
            texts += [" ".join(words), " ".join(changed(rng, words, n // 100))]
    want = brute_groups(texts)
    got = {r["doc_id"] for r in simhash.deduplicate(make(texts)).collect()}
    assert got >= want and len(texts) - len(got) >= 0.98 * (len(texts) - len(want))


def test_crowds_of_short_texts(spark, make):
    """A third of the rows share their first shingles; the parts of the crowd are compared with all others."""
    rng = random.Random(22)
    same = " ".join(f"s{i}" for i in range(7))
    texts = [f"{same} {rng.choice(['x', 'y'])} t{rng.randrange(30)} u{rng.randrange(3)}" for _ in range(60)] + [prose(rng, 12) for _ in range(120)]
    want = brute_groups(texts)
    for crowd in (simhash.CROWD, 8, 2):
        assert {r["doc_id"] for r in simhash.deduplicate(make(texts), crowd=crowd).collect()} == want


def test_repeated_ids_with_other_texts(spark):
    rng = random.Random(23)
    a, b, c = (" ".join(f"b{rng.getrandbits(40)}" for _ in range(100)) for _ in range(3))
    df = spark.createDataFrame([(1, a, "x"), (5, a, "x"), (5, b, "x"), (7, b, "x"), (7, c, "z"), (7, c, "y")], "doc_id bigint, text string, mark string")
    assert sorted(map(tuple, simhash.deduplicate(df).collect())) == sorted([(1, a, "x"), (5, b, "x"), (7, c, "y")])


def brute_order_minhash(text, k, width, sketches):
    codes = [ord(c) for c in text]
    h = orderminhash.kmers(np.array(codes, np.uint32), k)
    seen, numbered = {}, []
    for x in h.tolist():
        n = seen.get(x, 0)
        seen[x] = n + 1
        with np.errstate(over="ignore"):
            numbered.append(int(orderminhash.mix(np.array([x], np.uint64) + np.uint64(n) * np.uint64(0xD6E8FEB86659FD93))[0]))
    out = []
    for s in orderminhash._seeds(sketches).tolist():
        ranks = sorted(((x ^ s) * 0xBF58476D1CE4E5B9 % (1 << 64), i) for i, x in enumerate(numbered))[:width]
        value = s
        for i in sorted(i for _, i in ranks):
            value = int(orderminhash.mix(np.array([(value * orderminhash.FACTOR + int(h[i])) % (1 << 64)], np.uint64))[0])
        out.append(value >> 32)
    return out


@pytest.mark.parametrize("text", ["", "a", "abcabcabcabc" * 3, "ab" * 5000, "Ünïcödé 日本 text that is a little longer than k", "x" * 100])
def test_order_minhash_against_the_plain_version(text):
    assert orderminhash.fingerprint(text, 8, 2, 16).tolist() == brute_order_minhash(text, 8, 2, 16)
    assert orderminhash.fingerprint(text, 5, 3, 4).tolist() == brute_order_minhash(text, 5, 3, 4)


def test_order_minhash_kmers():
    text = "the cat sat on the mat the cat sat"
    h = orderminhash.kmers(np.frombuffer(text.encode("utf-32-le"), np.uint32), 7).tolist()
    runs = [text[i : i + 7] for i in range(len(text) - 6)]
    assert len(set(zip(runs, h))) == len(set(runs)) == len(set(h))


def test_order_minhash_feels_order():
    rng = random.Random(3)
    a, b = prose(rng, 200), prose(rng, 200)
    f = lambda t: orderminhash.fingerprint(t, sketches=256)
    assert orderminhash.likeness(f(a), f(a)) == 1
    small, swapped, other = f(a.replace("alpha", "alpho", 1)), f(a[len(a) // 2 :] + " " + a[: len(a) // 2]), f(b)
    assert orderminhash.likeness(f(a), small) > 0.8 > orderminhash.likeness(f(a), swapped) > orderminhash.likeness(f(a), other)


@pytest.mark.parametrize("parts", [1, 3, 64])
def test_order_minhash_of_neighbours(spark, parts):
    rng = random.Random(parts)
    texts = [*ODD, *(prose(rng, rng.randint(0, 60)) for _ in range(70))]
    ids = rng.sample(range(1000), len(texts))
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id bigint, text string").withColumn("part", F.lit("x")).repartition(4)
    got = {r["doc_id"]: r for r in orderminhash.with_following(df, parts=parts).collect()}
    order = sorted(zip(ids, texts), reverse=True)
    assert len(got) == len(texts)
    for (i, t), (_, n) in zip(order, [*order[1:], order[0]]):
        t, n = t or "", n or ""
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        a, b, c = (orderminhash.fingerprint(x) for x in (t, e, n))
        assert got[i].asDict() == {"doc_id": i, "n_chars": len(t), "edited_sha256": hashlib.sha256(e.encode()).hexdigest(), "fingerprint": orderminhash.hexed(a), "edited_fingerprint": orderminhash.hexed(b), "near_edited": orderminhash.likeness(a, b), "near_next": orderminhash.likeness(a, c)}


def test_order_minhash_ties_nulls_and_no_rows(spark):
    assert orderminhash.with_following(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    df = spark.createDataFrame([(5, "one"), (5, "one"), (5, "two"), (None, "x"), (None, None), (3, "y")], "doc_id bigint, text string")
    assert sorted(r["doc_id"] or -1 for r in orderminhash.with_following(df, parts=4).collect()) == [-1, -1, 3, 5, 5, 5]
    many = spark.createDataFrame([(5, f"text {i % 40}") for i in range(200)] + [(4, "last")], "doc_id bigint, text string").repartition(3)
    got = sorted(map(tuple, orderminhash.with_following(many, parts=8).collect()))
    assert got == sorted(map(tuple, orderminhash.with_following(many, parts=1).collect())) and len(got) == 201
    keyed = many.select(F.col("doc_id").alias("key"), F.xxhash64("text").alias("mark"))
    assert 5 <= len(orderminhash.cuts(keyed, 8)) <= 9  # ranges of one hot id
    alone = orderminhash.with_following(df.where("doc_id = 3")).first()
    assert (alone["n_chars"], alone["near_edited"], alone["near_next"]) == (1, 1.0, 1.0)


@pytest.fixture(scope="module")
def codec():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return bpe.Codec(f.read(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def plain(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def same(codec, plain, texts):
    ids = codec.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [plain.encode_ordinary(t) for t in texts]
    assert [codec.decode(x).decode() for x in ids] == texts


def test_bpe_of_random_texts(codec, plain):
    rng = random.Random(5)
    parts = ["a", "b", "aa", " ", "the", "ing", "é", "日本", "\n", "\t", "1", "23", "'s", "!!", "😀", " ", "er", "on", "\x1c", " "]
    same(codec, plain, ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(1500)])
    same(codec, plain, ["".join(rng.choice("estaionr") for _ in range(rng.randint(1, 300))) for _ in range(300)])


def test_bpe_of_long_pieces(codec, plain):
    rng = random.Random(6)
    same(codec, plain, ["a" * n for n in range(1, 200, 7)] + ["ab" * 500, "the" * 700, "é" * 1000, "x" * 50_000, "!" * 3001, " " * 2000, "".join(rng.choice("abcdefghij") for _ in range(20_000))])


def test_rank_queue():
    rng = random.Random(7)
    q, want = bpe.RankQueue(70_000), {}
    for _ in range(3000):
        if want and rng.random() < 0.4:
            r, at = q.pop()
            assert r == min(want) and sorted(at.tolist()) == sorted(want.pop(r))
        else:
            r, p = rng.randrange(70_000), rng.randrange(99)
            q.push(r, np.array([p]))
            want.setdefault(r, []).append(p)
    while want:
        r, at = q.pop()
        assert r == min(want) and sorted(at.tolist()) == sorted(want.pop(r))
    assert q.pop() is None


def test_ranks_that_fall():
    """A merge that opens a pair of a lower rank is followed by that pair, as one at a time would."""
    import base64

    tokens = [bytes([i]) for i in range(256)] + [b"abc", b"bc", b"ab", b"aab", b"ca"]
    ranks = b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens))
    own = bpe.Codec(ranks, ".+")
    other = tiktoken.Encoding("own", pat_str=".+", mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    assert own.falls
    rng = random.Random(9)
    same(own, other, ["".join(rng.choice("abc") for _ in range(n)) for n in range(1, 300)])


def test_bpe_tables(spark, odd, codec, plain):
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    whole = bpe.encode(odd, path, pattern)
    got = {r["doc_id"]: r for r in whole.collect()}
    assert {i: got[i]["ids"] for i in got} == {i: plain.encode_ordinary(t or "") for i, t in enumerate(ODD)}
    assert all(r["round_trip"] for r in got.values())
    back = {r["doc_id"]: r["text"] for r in bpe.decode(whole, path, pattern).collect()}
    assert back == {i: t or "" for i, t in enumerate(ODD)}
    digests = {r["doc_id"]: r for r in bpe.encode(odd, path, pattern, digests=True).collect()}
    for i, t in enumerate(ODD):
        ids = np.array(plain.encode_ordinary(t or ""), "<u4").tobytes()
        assert digests[i].asDict() == {"doc_id": i, "n_tokens": len(ids) // 4, "ids_sha256": hashlib.sha256(ids).hexdigest(), "decoded_sha256": hashlib.sha256((t or "").encode()).hexdigest()}
    assert bpe.encode(odd.limit(0), path, pattern).count() == 0
