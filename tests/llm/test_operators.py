"""Each operator against a plain reading of its definition, on a small table
with nulls, empty and long texts, ties, repeated rows and clashing names."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from basketry.llm import (bpe, cotrain, exact_dedup, gru, langid, licenses, lm, mixing, pretokens,
                          quality, simhash, token_counts)
from basketry.llm.common import ascii_lower, table
from basketry.llm.queries import BYTE_BPE, LOWERED, RANKS

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, "
          "h string, row string, copies string, fp string, words string, n bigint, y string")


def _words(t):
    return re.findall("[^\x20\x09-\x0D]+", t or "")


def _lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def _texts():
    rng = random.Random(3)
    vocab = {"en": "the of and to in river stone light under over and".split(),
             "de": "der die und zu über straße licht wasser größe nicht".split()}
    out = []
    for i in range(60):
        lang = "en" if i % 3 else "de"
        out.append((" ".join(rng.choice(vocab[lang]) for _ in range(rng.randint(5, 120))), lang))
    long = " ".join(rng.choice(vocab["en"]) + str(rng.randrange(9)) for _ in range(20000))
    out += [(None, "en"), ("", "en"), (" \n\t ", None), ("İI K Ä ä É é", "de"), (long, "en"),
            ("x", "en"), ("12345 !!!", None), ("a<|endoftext|>b", "en"), ("y" * 30000, "en"),
            ("Under the MIT license, cc by-nc. Apache License, Version 2.0", "en"),
            ("cc by nc cc by nc", None), ("日本語のテキスト 한국어 русский", "ja")]
    copy = out[5][0]
    out += [(copy, "en"), (copy.upper(), "en"), (copy.replace("the", "tha", 1), "en"), (copy, None)]
    return out


@pytest.fixture(scope="module")
def rows():
    out = []
    for i, (t, lang) in enumerate(_texts()):
        source = [None, "s1", "s2", "s1", "é"][i % 5]
        out.append((i, t, lang, source, len(t or "")))
    out += [out[3], out[5], (None, "no id here at all", "en", "s1", 17),
            (None, None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark.createDataFrame([(*r, "x", "x", "x", "x", "x", "x", 1, "x") for r in rows],
                                       SCHEMA).repartition(3), "test-docs")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _by_id(df):
    return collections.Counter(tuple(r) for r in df.collect())


def test_ascii_lower(spark, rows):
    got = spark.createDataFrame([(r[1],) for r in rows], "t string").select(
        "t", ascii_lower(F.coalesce("t", F.lit(""))).alias("l")).collect()
    assert all(r["l"] == _lower(r["t"]) for r in got)


# ---------------------------------------------------------------- exact dedup
@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_groups(docs, rows, keep):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[_lower(r[1])].append(r[0])
    want = collections.Counter()
    for r in rows:
        ids = groups[_lower(r[1])]
        known = [i for i in ids if i is not None]
        stay = ({"min": min, "max": max}[keep])(known) if known else None
        want[(r[0], stay, len(ids), r[0] == stay,
              hashlib.sha256(_lower(r[1]).encode()).hexdigest())] += 1
    assert _by_id(exact_dedup.groups(docs, keep)) == want


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_survivors(docs, rows, keep):
    got = exact_dedup.survivors(docs, keep)
    assert got.columns == docs.columns
    out = got.collect()
    assert collections.Counter(_lower(r["text"]) for r in out) == {_lower(r[1]): 1 for r in rows}
    for r in out:
        ids = [x[0] for x in rows if _lower(x[1]) == _lower(r["text"]) and x[0] is not None]
        assert r["doc_id"] == (({"min": min, "max": max}[keep])(ids) if ids else None)
        assert r["kept"] == "x" and (r["doc_id"], r["text"]) in {x[:2] for x in rows}


def test_exact_collision(docs, rows, monkeypatch):
    """All texts share a hash: the bytes alone decide."""
    want = _by_id(exact_dedup.groups(docs, "min"))
    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: F.substring(F.lit("same"), 1, 4))
    assert _by_id(exact_dedup.groups(docs, "min")) == want


# ---------------------------------------------------------------- simhash
def _fingerprint(text, width=4):
    import xxhash
    w = _words(_lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i:i + width]) for i in range(max(1, len(w) - width + 1))]
    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def _components(fps, k):
    n = len(fps)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    for i in range(n):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= k:
                root[find(i)] = find(j)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("leaves", [simhash.LEAVES, 8, 1])
def test_simhash(docs, rows, leaves):
    fps = [_fingerprint(r[1]) for r in rows]
    comp = _components(fps, 4)
    least = {c: min((r[0] for r, d in zip(rows, comp) if d == c and r[0] is not None),
                    default=None) for c in set(comp)}
    want = collections.Counter((r[0], f"{f:016x}", least[c]) for r, f, c in zip(rows, fps, comp))
    got = simhash.near_duplicates(docs, 4, 4, leaves).select(
        "doc_id", simhash.hex_digits(F.col("fp")), "component_id")
    assert _by_id(got) == want


@pytest.mark.parametrize("k", [0, 1, 3, 4, 7])
def test_trie_links(spark, k):
    """Dense and sparse fingerprints, at several sizes of a subtree."""
    rng = random.Random(k)
    fps = {0, (1 << 64) - 1}
    for _ in range(12):
        base = rng.getrandbits(64)
        fps.add(base)
        for _ in range(12):
            v = base
            for _ in range(rng.randint(0, k + 2)):
                v ^= 1 << rng.randrange(64)
            fps.add(v)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = table(spark.createDataFrame([(f,) for f in signed], "fp bigint"), "test-fps")
    comp = _components(fps, k)
    want = collections.defaultdict(set)
    for f, c in zip(signed, comp):
        want[c].add(f)
    want = {frozenset(v) for v in want.values() if len(v) > 1}
    for leaves in (simhash.LEAVES, 16, 1) if k == 4 else (16,):
        got = collections.defaultdict(set)
        for r in simhash.components(simhash.links(frame, k, leaves)).collect():
            got[r["root"]] |= {r["u"], r["root"]}
        assert {frozenset(v) for v in got.values()} == want


def test_walk_in_small_chunks():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    keys = np.unique(np.concatenate([base ^ (np.uint64(1) << np.uint64(s)) for s in range(60)]))
    a = simhash.walk(keys, 0, (0, len(keys)), (0, len(keys)), 4, 2)
    b = simhash.walk(keys, 0, (0, len(keys)), (0, len(keys)), 4, 2, chunk=50)
    assert np.array_equal(a, b) and len(set(a.tolist())) < len(keys)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(500, 499)],
                                  "u bigint, v bigint")
    got = {r["u"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 500: 499}


def test_simhash_survivors(docs):
    found = simhash.near_duplicates(docs).collect()
    stay = {r["component_id"] for r in found}
    out = simhash.survivors(docs)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == stay


# ---------------------------------------------------------------- mixing
def _targets(rows, weights=(5, 2, 1), share=1.5, most=2):
    size = collections.Counter()
    for r in rows:
        size[r[3]] += len(_words(r[1]))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weigh = {s: weights[i % 3] for i, s in enumerate(names)}
    out, rest = {}, set(names)
    left = share * sum(size.values())
    while True:
        per = left / sum(weigh[s] for s in rest) if rest else 0
        over = [s for s in rest if per * weigh[s] > most * size[s]]
        if not over:
            return size, out | {s: per * weigh[s] for s in rest}
        for s in over:
            out[s] = most * size[s]
            left -= out[s]
            rest.remove(s)


def _mixed(docs):
    sized = table(mixing.sizes(docs), "test-sizes")
    return sized, table(mixing.mix(sized, table(mixing.targets(sized), "t")), "test-mix")


@pytest.mark.parametrize("fan", [mixing.FAN, 3])
def test_mixing(docs, rows, monkeypatch, fan):
    monkeypatch.setattr(mixing, "FAN", fan)
    size, target = _targets(rows)
    sized, mixed = _mixed(docs)
    got = mixed.collect()
    assert {(r["doc_id"], r["source"], r["size"]) for r in got} == {
        (r[0], r[3], len(_words(r[1]))) for r in rows}
    copies = {(r["doc_id"], r["source"], r["size"]): r["copies"] for r in got}
    taken, largest = collections.Counter(), collections.Counter()
    for r in rows:
        n = len(_words(r[1]))
        c = copies[(r[0], r[3], n)]
        assert 0 <= c <= 2
        taken[r[3]] += c * n
        largest[r[3]] = max(largest[r[3]], n)
    for r in got:
        assert r["source_size"] == size[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
    for s, t in target.items():
        assert abs(taken[s] - t) <= largest[s]
    assert _by_id(_mixed(docs)[1]) == collections.Counter(tuple(r) for r in got)
    out = mixing.repeat(docs, mixed)
    assert out.columns == docs.columns
    again = collections.Counter((r["doc_id"], r["text"]) for r in out.collect())
    want = collections.Counter()
    for r in rows:
        want[r[:2]] += copies[(r[0], r[3], len(_words(r[1])))]
    assert again == +want


def test_mixing_large_hot_source(spark):
    """One source with most rows: the tree has several levels, words stay near."""
    rng = random.Random(5)
    sized = [(i, "hot" if i % 5 else f"s{i % 25}", rng.randint(1, 400)) for i in range(4000)]
    frame = table(spark.createDataFrame(sized, "doc_id bigint, source string, size bigint"), "hot")
    mixed = mixing.mix(frame, table(mixing.targets(frame), "t")).collect()
    taken, target = collections.Counter(), {}
    for r in mixed:
        taken[r["source"]] += r["copies"] * r["size"]
        target[r["source"]] = r["target"]
    assert len(mixed) == 4000 and len(target) > 2
    assert all(abs(taken[s] - t) <= 400 for s, t in target.items())
    assert sum(target.values()) == pytest.approx(1.5 * sum(s for _, _, s in sized))


# ---------------------------------------------------------------- tokens
def _odd_texts():
    rng = random.Random(1)
    pick = lambda: chr(rng.choice([rng.randrange(32, 0x3000), rng.randrange(0x3000, 0xD800),
                                   rng.randrange(0xE000, 0x11000)]))
    return (["".join(rng.choice("ab '\n\té1.!") for _ in range(120)) for _ in range(150)]
            + ["".join(pick() for _ in range(60)) for _ in range(150)]
            + ["aaaaaaaa aaaa", "<|endoftext|>", "x<|endoftext|>y <|endoftext|>", " " * 3000,
               "ab" * 2000, "\x00", "don't 'S're''s"])


def test_known_code_points_are_cut_alike():
    t, c = pretokens.library(BYTE_BPE), pretokens.cutter(BYTE_BPE)
    for a, b in pretokens.KNOWN:
        points = [p for p in range(a, b + 1) if not 0xD800 <= p <= 0xDFFF]
        for lo in range(0, len(points), 500):
            s = "".join(f"a{chr(p)}1{chr(p)}! {chr(p)}" for p in points[lo:lo + 500])
            assert pretokens.exact(s)
            want = [s[i:j] for _, (i, j) in t.pre_tokenizer.pre_tokenize_str(s)]
            assert c._cut(s) == want


def test_bpe_matches_library(spark, rows):
    t = pretokens.library(BYTE_BPE)
    texts = [r[1] for r in rows] + _odd_texts()
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in bpe.round_trip(frame, BYTE_BPE).collect()}
    coded = bpe.encode(frame, BYTE_BPE)
    again = {r["doc_id"]: r["decoded"] for r in bpe.decode(coded, BYTE_BPE).collect()}
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids
        assert got[i]["decoded"] == again[i] == t.decode(ids, skip_special_tokens=False)


def test_bpe_stretches(monkeypatch, spark, docs):
    want = _by_id(bpe.encode(docs, BYTE_BPE).selectExpr("doc_id", "to_json(ids)"))
    assert sum(want.values()) == docs.count()
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": ["abc", None, "d" * 9]})
    monkeypatch.setattr(bpe, "STRETCH", 5)
    assert [(lo, t) for lo, t in bpe._stretches(batch, 1)] == [(0, ["abc", ""]), (2, ["d" * 9])]


@pytest.mark.parametrize("sample", [token_counts.SAMPLE, 1])
def test_token_counts(spark, rows, sample):
    t = pretokens.library(BYTE_BPE)
    texts = [r[1] for r in rows] + _odd_texts()
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"])
           for r in token_counts.count_tokens(frame, BYTE_BPE, sample).collect()}
    assert got == {i: (len((x or "").encode()),
                       len(t.encode(x or "", add_special_tokens=False).ids))
                   for i, x in enumerate(texts)}


def test_token_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE", 3)
    own = token_counts.Lengths(BYTE_BPE, {" the": 1})
    t = pretokens.library(BYTE_BPE)
    for text in (" the river stone", " light under over the", " water"):
        pieces = pretokens.cutter(BYTE_BPE).pieces(text)
        assert own.total(pieces) == len(t.encode(text, add_special_tokens=False).ids)
        assert len(own) <= 1 + max(3, len(pieces))
    assert own.total(["a" * 300, "b"]) == len(t.encode("a" * 300).ids) + 1
    assert "a" * 300 not in own


def test_frequent_table_round_trip():
    known = {" the": 1, "é": 2, "日": 3}
    assert token_counts.unpack(token_counts.pack(known)) == known
    assert token_counts.unpack(token_counts.pack({})) == {}


# ---------------------------------------------------------------- language model
def test_language_model(docs, rows):
    learn = F.coalesce(F.col("doc_id") % 4 != 0, F.lit(False))
    train = [r for r in rows if r[0] is not None and r[0] % 4 != 0]
    c = collections.Counter()
    for r in train:
        c.update([*(_words(_lower(r[1]))), None])
    total, distinct = sum(c.values()), len(c)
    got = lm.learn_and_score(docs, learn).collect()
    assert len(got) == len(rows)
    want = collections.Counter()
    for r in rows:
        w = [*_words(_lower(r[1])), None]
        base = sum(math.log10((c[x] + .1) / (total + .1 * (distinct + 1))) for x in w)
        want[(r[0], len(w), sum(c[x] > 0 for x in w), total, round(base, 6))] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"],
                                round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


needs_tables = pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")


@needs_tables
def test_language_model_does_not_depend_on_the_files(spark):
    """The same rows in 1, 8 and 32 files give the same model, which beats the
    words' own frequencies on texts it has not seen."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    gains = []
    for files in (1, 8, 32):
        own = table(docs.repartition(files, F.hash("text")), "files")
        got = lm.learn_and_score(own, ~held).where(held).agg(
            *map(F.sum, ("score", "base_score", "n_tokens"))).first()
        gains.append((got[0] - got[1]) / got[2])
    assert gains[0] > 0.2
    assert gains[1:] == pytest.approx([gains[0]] * 2, rel=0.01)


def test_trainers_are_averaged(spark, monkeypatch):
    """Many trainers, averaged along a tree of small fan, learn as well as one."""
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a b c d", "e f g", "d c b a"]) for _ in range(20))
             for _ in range(600)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    counts = table(lm.count_words(frame), "c")
    lex = lm.lexicon(counts, 600)
    coded = table(lm.code(frame, F.lit(True), lex), "coded")
    lines = [np.frombuffer(r["line"], np.int16) for r in coded.select("line").collect()]
    start = gru.score(gru.Model.start(lex.counts()), lines).sum()
    monkeypatch.setattr(lm, "FAN", 2)
    for least in (10 ** 9, lex.total // 5):
        learned = gru.score(lm.train(coded, lex, rounds=3, least=least), lines).sum()
        assert learned > 0.9 * start
    assert coded.where("octet_length(line) = 2 * 0").count() == 0


def test_pieces_hold_every_token(spark, monkeypatch):
    monkeypatch.setattr(lm, "PIECE", 7)
    lines = [np.arange(n, dtype=np.int16) for n in (1, 6, 7, 8, 30)]
    frame = spark.createDataFrame([(i, True, x.tobytes()) for i, x in enumerate(lines)]
                                  + [(9, False, b"ab")], "doc_id bigint, learns boolean, line binary")
    got = [np.frombuffer(r["line"], np.int16) for r in lm.pieces(frame).collect()]
    assert all(0 < len(x) <= 7 for x in got)
    assert sorted(np.concatenate(got).tolist()) == sorted(np.concatenate(lines).tolist())


def test_words_and_buckets_of_a_batch():
    """All of a batch's words at once, as the plain definition cuts each text."""
    texts = ["Ab c", None, "", "  x\ty\x0bz\x0c\r\n ", "\x1cA\x1f\x85\u2003É Größe.", "   ",
             "a" * 300 + " é! ###\x00 the, longerword?", "\x20".join(map(chr, range(1, 200)))]
    column = pa.array(["before", *texts, "after"]).slice(1, len(texts))
    words, at = lm.words_of(column)
    got = [words[i:j].to_pylist() for i, j in zip(at, at[1:])]
    want = [(t or "").encode().lower().split() for t in texts]
    assert got == want == [[w.encode() for w in _words(_lower(t or ""))] for t in texts]
    assert lm.buckets(words).tolist() == [lm.bucket(w) for t in want for w in t]
    assert lm.buckets(words[3:5]).tolist() == [lm.bucket(w) for w in words[3:5].to_pylist()]
    words, at = lm.words_of(pa.array([None, " ", ""], pa.string()))
    assert len(words) == 0 and at.tolist() == [0] * 4 and not len(lm.buckets(words))


def test_coded_texts_by_hand(spark, monkeypatch):
    """Ids, known words and the other words of every text, with a head of three."""
    monkeypatch.setattr(lm, "WORDS", 2)
    texts = ["b a zz. zz. c", None, " zz. ", "a A a c", "", "é 12345678901 é"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    tail_c, tail_v = np.full(lm.TAIL + 1, 50.), np.full(lm.TAIL + 1, 5.)
    lex = lm.Lexicon([(b"a", 9), (b"b", 7), (b"c", 4)], 6, 100, 20, tail_c, tail_v)
    ids, known = lex.ids(), {b"a": 9, b"b": 7, b"c": 4}
    for r in lm.code(frame, F.lit(True), lex).collect():
        own = (texts[r["doc_id"]] or "").encode().lower().split()
        assert np.frombuffer(r["line"], np.int16).tolist() == [
            *(ids.get(w, lm.bucket(w)) for w in own), gru.END]
        assert r["n_known"] == sum(w in known for w in own) + 1
        assert {(bytes(x["word"]), x["bucket"], x["n"]) for x in r["rare"]} == {
            (w, lm.bucket(w), n) for w, n in collections.Counter(own).items() if w not in known}
        assert len(r["rare"]) == len({bytes(x["word"]) for x in r["rare"]})
        assert r["base_score"] == pytest.approx(sum(
            math.log10((c + .1) / (100 + .1 * 21))
            for c in [6, *(known[w] for w in own if w in known)]))
        assert r["score"] == pytest.approx(sum(
            math.log10((4 + .1) / (50 + .1 * 6)) for w in own if w == b"c"))


def test_counts_are_added_up_in_parts(spark, docs, rows, monkeypatch):
    want = collections.Counter(w for r in rows for w in _words(_lower(r[1])))
    for held, size in ((1, 1 << 26), (1 << 20, 1), (1 << 20, 1 << 26)):
        monkeypatch.setattr(lm, "HELD", held)
        monkeypatch.setattr(lm, "HELD_BYTES", size)
        got = {bytes(r["word"]).decode(): r["c"] for r in lm.count_words(docs).collect()}
        assert got == want


def test_word_buckets_agree(spark):
    words = [w.encode() for w in ("a", "the,", "straße", "größe.", "x" * 9, "###", "é!", "longerword?")]
    frame = spark.createDataFrame([(w,) for w in words], "word binary")
    got = frame.select("word", lm._bucket(F.col("word")).alias("b")).collect()
    assert all(r["b"] == lm.bucket(bytes(r["word"])) for r in got)


def test_network_is_a_distribution():
    """Probabilities of all tokens after a prefix add up to one, and scoring in
    lanes and windows equals a plain walk through one document."""
    rng = np.random.default_rng(0)
    size = gru.CLASSES * gru.MEMBERS
    docs = [np.append(rng.integers(1, size, n), gru.END).astype(np.int16)
            for n in (0, 3, 70, 150, 9, 40)]
    model = gru.Model.start(rng.integers(0, 50, size).astype(float))
    gru.fit(model, gru.Adam(model), docs * 20, lanes=8)
    prefix = docs[2][:10]
    every = [np.concatenate((prefix, [t])).astype(np.int16) for t in range(size)]
    part = np.zeros(size)
    for i, d in enumerate(every):
        part[i] = gru.score(model, [d])[0]
    assert (10 ** (part - gru.score(model, [prefix])[0])).sum() == pytest.approx(1, abs=1e-3)
    alone = np.array([gru.score(model, [d], window=7)[0] for d in docs])
    assert np.allclose(alone, gru.score(model, docs), atol=1e-3)
    assert np.allclose(alone, gru.score(model, docs, lanes=2, window=5), atol=1e-3)


def test_gradient_matches_differences():
    rng = np.random.default_rng(1)
    size = gru.CLASSES * gru.MEMBERS
    model = gru.Model.start(np.ones(size))
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    ids = rng.integers(0, 40, (6, 3))
    target = rng.integers(0, size, (6, 3))
    live = np.ones((6, 3), bool)
    live[5, 2] = False
    h = np.zeros((3, gru.HIDDEN))
    grads, _, _ = model.gradient(ids, ids == 0, target, live, h)
    for name in model.NAMES:
        flat = model.p[name].reshape(-1)
        at = int(np.argmax(np.abs(grads[name])))
        old, losses = flat[at], []
        for step in (1e-2, -1e-2):
            flat[at] = old + step
            losses.append(-model.gradient(ids, ids == 0, target, live, h)[1] / live.sum())
        flat[at] = old
        assert grads[name].reshape(-1)[at] == pytest.approx((losses[0] - losses[1]) / 2e-2,
                                                            rel=0.05, abs=1e-4)


# ---------------------------------------------------------------- language ID
def test_language_id(docs, rows):
    learn = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2,
                       F.lit(True))
    got = langid.identify(docs, learn).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r for r in rows}
    right = n = 0
    for r in got:
        if r["doc_id"] is None:
            continue
        text, lang = texts[r["doc_id"]][1:3]
        if not text or not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        assert 0 < r["score"] <= 1 and r["lang_pred"] in ("en", "de", "ja")
        if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 and len(_words(text)) > 4:
            n, right = n + 1, right + (r["lang_pred"] == lang)
    assert n > 5 and right >= 0.9 * n


def test_language_model_counts(spark):
    frame = spark.createDataFrame([("aB", "x"), ("ab!", "x"), ("z", "y"), (None, "x"), ("q", None)],
                                  "text string, lang string")
    got = {(r["lang"], r["bucket"]): r["c"] for r in langid.train(frame).collect()}
    want = collections.Counter()
    for t, g in (("ab", "x"), ("ab", "x"), ("z", "y")):
        want[(g, -1)] += 1
        for b in langid.buckets(t).tolist():
            want[(g, b)] += 1
    assert got == dict(want) and len(langid.buckets("ab")) == 4 + 3 + 2
    assert langid.buckets("aB, ??").tolist() == langid.buckets("ab").tolist()


# ---------------------------------------------------------------- licenses
def test_license_scan(docs, rows):
    got = {(r["doc_id"], r["n_words"]): r for r in licenses.scan(docs).collect()}
    assert docs.count() == licenses.scan(docs).count()
    for r in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(r[1]))
        places, labels = [], set()
        for label, phrase in licenses.PHRASES:
            p = phrase.split()
            at = [i for i in range(len(w)) if w[i:i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        g = got[(r[0], len(w))]
        assert (g["n_base"], g["first_word"], g["last_word"], g["base_labels"]) == (
            len(places), min(places, default=None), max(places, default=None),
            ",".join(sorted(labels)))
        assert set(g["base_labels"].split(",")) <= set(g["labels"].split(","))
        assert 0 <= g["score"] <= 1


def test_license_notice_with_inserted_words(spark):
    notice = licenses.NOTICES[10][1].split()
    cut = " ".join(notice[:12] + ["kindly"] + notice[12:])
    twice = f"{cut} {'word ' * 40} {cut}"
    few = " ".join(notice[:5])
    frame = spark.createDataFrame([(1, twice), (2, few), (3, "all rights reserved")],
                                  "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in licenses.scan(frame).collect()}
    assert got[1]["labels"] == "mit" and got[2]["labels"] == ""
    assert got[3]["labels"] == "all-rights-reserved" and got[3]["n_base"] == 0
    spans = licenses.spans(licenses.diagonals(frame)).where("label = 'mit'").collect()
    assert sorted(r["first"] for r in spans) == [0, len(notice) + 41]


def test_license_spans_need_different_grams_in_order(spark):
    isc = licenses.NOTICES[8][1].split()
    mpl = "mozilla public license version 2 0"
    texts = ["licensed creative commons attribution sharealike or creative commons attribution "
             "noderivs",                                     # one gram of cc-by-nc, twice
             "a general public license and the general public license",
             " ".join(isc[12:] + isc[:12]),                  # both halves, the wrong way round
             " ".join(f"creative commons attribution w{i}" for i in range(40))
             + " commons attribution noncommercial",
             " ".join(isc[i // 2] if i % 2 else "x" for i in range(2 * len(isc))),
             f"creative commons attribution noncommercial, {mpl} {mpl}",
             " ".join(isc[:9] + ["dearly"] + isc[9:]), " ".join(isc[:9] + isc[11:])]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(frame).collect()}
    assert [got[i][0] for i in range(len(texts))] == [
        "cc-by-sa", "", "", "cc-by-nc", "", "cc-by-nc,mpl-2", "isc", "isc"]
    assert got[0][1] == got[5][1] == 1
    n = len(isc) - 2
    assert got[6][1] == pytest.approx((n - 2) / n) and got[7][1] == pytest.approx((n - 4) / n)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    names = licenses.scan(frame).columns
    want = con.execute(f"SELECT {', '.join(names)} FROM ({licenses.sql(LOWERED)})").fetchall()
    assert sorted(map(tuple, licenses.scan(frame).collect()), key=str) == sorted(want, key=str)
    # every gram once, but on diagonals further apart than the template is long
    far = spark.createDataFrame(
        [(1, 0, 99, 7, "x", False, 8, 5 * i, 1 << i) for i in range(8)],
        "doc_id int, row int, n_words int, template int, label string, base boolean, grams int, "
        "diagonal int, mask bigint")
    assert [r["label"] for r in licenses.spans(far).collect()] == [None]


def test_license_templates_have_a_bit_for_each_gram(spark):
    frame = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(70)))],
                                  "doc_id bigint, text string")
    for n, label in ((licenses.MOST_GRAMS, "long"), (licenses.MOST_GRAMS + 1, None)):
        notice = (("long", " ".join(f"w{i}" for i in range(n + licenses.K - 1))),)
        if label:
            assert licenses.scan(frame, (), notice).first()["labels"] == label
        else:
            with pytest.raises(ValueError):
                licenses.scan(frame, (), notice)


# ---------------------------------------------------------------- quality rules
def test_quality_base(spark, rows):
    shout = " ".join(["LOOK!! HERE!! NOW!!"] * 30)
    texts = [r[1] for r in rows] + [shout, "a\na\n\nb\n a\na", "x# y* z$ <w> |"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["id"]: r for r in quality.judge(frame, RANKS).select(
        F.col("doc.doc_id").alias("id"), "m.*", "base_failed", "kept").collect()}
    for i, text in enumerate(texts):
        w = _words(text)
        windows = collections.Counter(tuple(w[j:j + 8]) for j in range(len(w) - 7))
        cover = set()
        for j in range(len(w) - 7):
            if windows[tuple(w[j:j + 8])] > 1:
                cover |= set(range(j, j + 8))
        seen, dup = set(), 0
        for line in (text or "").split("\n"):
            if _words(line):
                dup += line in seen
                seen.add(line)
        g = got[i]
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"],
                g["n_repeat_words"]) == (len(w), sum(map(len, w)),
                                         len(re.findall(r"[#*$%&|<>]", text or "")), dup,
                                         len(cover))
        assert g["base_failed"] == (len(w) < 20 or 100 * len(cover) > 30 * len(w))
        assert not (g["kept"] and g["base_failed"])
    assert got[len(rows)]["base_failed"]


def test_fertility_bands(spark):
    prose = ("It was a long evening by the river, and nobody in the village could say when the "
             "lights on the far bank had gone out or who had walked down there to see. ")
    german = ("Die Straße führte über den Fluss, und niemand im Dorf wusste, wann die Lichter am "
              "anderen Ufer erloschen waren oder wer hinuntergegangen war. ")
    russian = "Вечером у реки никто не мог сказать когда погасли огни на дальнем берегу. "
    noise = " ".join(f"{a}$$$" if i % 2 else f"{a}###" for i, a in enumerate(["aa", "ba", "ca"] * 40))
    frame = spark.createDataFrame([(1, prose), (2, german), (3, russian), (4, noise)],
                                  "doc_id bigint, text string")
    got = {r["id"]: r["ok"] for r in quality.judge(frame, RANKS).select(
        F.col("doc.doc_id").alias("id"), quality.in_bands(F.col("m")).alias("ok")).collect()}
    assert got == {1: True, 2: True, 3: True, 4: False}
    assert quality.script_of("Вечером abc") == "cyrillic" and quality.script_of("12 !") == "other"


def _letters(first, last):
    return [chr(c) for c in range(first, last) if chr(c).isalpha()]


def _noise(rng, letters, n=300):
    return " ".join("".join(rng.choices(letters, k=rng.randint(3, 9))) for _ in range(n))


#: By script: prose, letters for noise of least characters per token and of most fallback.
SCRIPT_TEXTS = {
    "latin": ("It was a long evening by the river, and nobody could say when the lights went out",
              _letters(97, 123), _letters(0xC0, 0x250)),
    "cyrillic": ("Вечером у реки никто не мог сказать когда погасли огни на дальнем берегу",
                 _letters(0x460, 0x530), _letters(0x460, 0x530)),
    "cjk": ("傍晚的河边 村里没有人 说得清 对岸的灯 是什么时候 熄灭的 也不知道 是谁走过去 看了 老人坐在 窗前",
            _letters(0x20000, 0x2A6D0), _letters(0x4E00, 0x9FA6)),
    "other": ("शाम को नदी के किनारे कोई नहीं बता सका कि दूर के किनारे की रोशनी कब बुझ गई",
              _letters(0x13000, 0x13400), _letters(0x904, 0x93A)),
}


@pytest.mark.parametrize("half", [1, 10 ** 9])
def test_each_band_of_each_script_fires(spark, monkeypatch, half):
    """With bounds that follow the documents and with the wide ones."""
    monkeypatch.setattr(quality, "HALF", half)
    rng = random.Random(5)
    texts, names = [], []
    for script, (prose, low, part) in SCRIPT_TEXTS.items():
        words = prose.split()
        for _ in range(150):
            texts.append(" ".join(rng.choices(words, k=40)))
            names.append((script, "prose"))
        # with the wide limits only letters that no vocabulary knows are too short for Latin
        low = low if half == 1 else part if script == "latin" else low
        for kind, t in (("least", _noise(rng, low)), ("fallback", _noise(rng, part)),
                        ("most", " ".join(w + " " + "-" * 200 for w in words * 3))):
            assert quality.script_of(t) == script
            texts.append(t)
            names.append((script, kind))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    judged = table(quality.judge(frame, RANKS), "judged")
    bands = quality.bands_of(judged)
    got = {r["id"]: r for r in judged.select(
        F.col("doc.doc_id").alias("id"), "m.*", "base_failed", "kept").collect()}
    for i, (script, kind) in enumerate(names):
        g, (lo, hi) = got[i], bands[script]["per_token"]
        one, two = g["chars_per_token"], g["chars_per_token_2"]
        assert g["script"] == script
        if kind == "prose":
            assert lo <= max(one, two) and min(one, two) <= hi
            assert g["fallback_share"] <= bands[script]["fallback"]
        else:
            assert not g["kept"]
            assert {"least": max(one, two) < lo, "most": min(one, two) > hi,
                    "fallback": g["fallback_share"] > bands[script]["fallback"]}[kind]


def test_bands_follow_the_documents(spark, monkeypatch):
    """Quantiles are those of a plain sort, to a step of the histogram; the bounds
    go n / (n + HALF) of the way to them, with no jump at any number of documents."""
    rng = random.Random(2)
    rows = [(("latin", 9, 2 + rng.random(), 2 + rng.random(), rng.random() / 5),) for _ in range(400)]
    frame = spark.createDataFrame(rows, "m struct<script:string,n_tokens:bigint,"
                                  "chars_per_token:double,chars_per_token_2:double,"
                                  "fallback_share:double>")
    limits = {"latin": dict(quality.LIMITS["latin"], least=(0.0, 9.0), most=(9.0, 0.0),
                            fallback=(1.0, 0.0))}
    shrunk = quality.bands_of(frame, limits)["latin"]
    monkeypatch.setattr(quality, "HALF", 0)
    got = quality.bands_of(frame, limits)["latin"]
    best = sorted(max(m[2:4]) for m, in rows)
    worst = sorted(min(m[2:4]) for m, in rows)
    share = sorted(m[4] for m, in rows)[395]
    assert got["per_token"] == pytest.approx((0.9 * best[19], 2 * worst[395]), abs=0.01)
    assert got["fallback"] == pytest.approx(share + 0.1 * (1 - share), abs=0.01)
    wide = [x[0] for x in (limits["latin"][k] for k in ("least", "most", "fallback"))]
    for a, b, w in zip((*shrunk["per_token"], shrunk["fallback"]),
                       (*got["per_token"], got["fallback"]), wide):
        assert a == pytest.approx(w + (b - w) * 400 / 500)
    monkeypatch.undo()
    before = None
    for n in (0, 1, 98, 99, 100, 101, 102):
        bands = quality.bands_of(frame.limit(400).orderBy("m").limit(n), limits)["latin"]
        if n > 98:          # one document more changes little, on either side of 100
            assert bands["per_token"][0] == pytest.approx(before["per_token"][0], abs=0.05)
            assert bands["fallback"] == pytest.approx(before["fallback"], abs=0.01)
        before = bands


def test_long_texts_are_measured_as_one():
    """Cut before a space between words, no token is broken: the measures are
    those of one encoding, on both sides of the length of a piece."""
    rng = random.Random(4)
    words = "river stone don't 12,345 größe «evening» light, x7 日本語 -- naïve".split()
    for n in (2_000, 9_000, 30_000):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\n", ". "])
                       for _ in range(n))
        (one, partial), (two, _) = map(quality.vocabulary, RANKS)
        ids, other = one.encode_ordinary(text), two.encode_ordinary(text)
        c = np.array(list(collections.Counter(ids).values())) / len(ids)
        assert quality.fertility(text, RANKS) == pytest.approx(
            (len(ids), len(text) / len(ids), len(text) / len(other), partial[ids].mean(),
             -(c * np.log2(c)).sum()))
        cut = list(quality.pieces(text))
        assert "".join(cut) == text and len(cut) >= len(text) // 60_000
    for run in ("y" * 200_000, " " * 1_200_000, "a" * 10 + "\n" * 700_000 + "b c"):
        assert "".join(quality.pieces(run)) == run
        assert quality.fertility(run, RANKS)[0] > 0


def test_fertility_of_very_long_runs():
    n, per, per2, fallback, entropy = quality.fertility(" " * 300_000, RANKS)
    assert n > 0 and per >= 1 and fallback == 0 and entropy < 2
    assert quality.fertility("", RANKS)[0] == 0


# ---------------------------------------------------------------- classifier
def test_co_training(spark, docs, rows):
    rng = random.Random(2)
    good, bad = "river stone light evening walk village".split(), "WIN CASH$$$ NOW!!! CLICK".split()
    data, labels = [], []
    for i in range(600):
        y = i % 3 != 0
        text = " ".join(rng.choice(good if y else bad) for _ in range(40))
        data.append((i, text, "en", rng.choice("abc") if y else rng.choice("cd"), len(text)))
        if i % 2:
            labels.append((i, int(y)))
    frame = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, "
                                        "n_chars bigint")
    marks = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id bigint, quality int")
    got = cotrain.classify(frame, marks).collect()
    assert len(got) == 600 and all(0 <= r["score"] <= 1 for r in got)
    assert sum(r["kept"] == (r["doc_id"] % 3 != 0) for r in got if r["doc_id"] % 2 == 0) > 290
    both = cotrain.classify(docs, marks.where("doc_id < 60"))
    assert both.count() == len(rows)                 # a column y of the documents is not read
    none = cotrain.classify(docs, marks.where("quality = 1")).collect()
    assert len(none) == len(rows) and all(r["score"] == 0.5 and r["kept"] for r in none)


def test_co_training_labels_and_draws(spark):
    """Majority labels, ties, repeated ids; thresholds and draws against a plain
    sort over all rows, not a pool."""
    frame = spark.createDataFrame(
        [(i, f"text {i}", None, None, None) for i in [*range(40), 7, 7]] + [
            (None, "none", None, None, None)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, 1), (2, 0), (7, 1), (None, 1),
                                    (8, None), (99, 1)], "doc_id bigint, quality int")
    seen = table(cotrain.views(frame), "seen")
    known, sample = cotrain.labelled_rows(seen, labels, "quality", 100)
    assert sorted((r["y"], bytes(r["at"])) for r in sample.collect()) == sorted(
        (y, cotrain.text_view(f"text {i}".encode())[0].tobytes())
        for i, y in ((1, 1), (2, 0), (7, 1)))
    assert known.count() == 5                       # each row of document 7
    rng = np.random.default_rng(0)
    n = 3000
    values = rng.normal(0, 3, n)
    odds = spark.createDataFrame(
        [(i, i * 7919 % 104729, 5, float(v)) for i, v in enumerate(values)],
        "row bigint, mark bigint, n bigint, o_text double")
    (low, n_low), (high, n_high) = cotrain.thresholds(odds, "o_text", 0.75, 0.1)
    ordered = np.sort(values)
    step = lambda v: np.floor((v + cotrain.TOP) * cotrain.STEPS)
    assert step(ordered[74]) == low - 1 and step(ordered[-225]) == high
    assert n_low == (step(values) < low).sum() and n_high == (step(values) >= high).sum()
    got = cotrain.draw(odds, "o_text", 0.75, 0.1, 40, 1).collect()
    assert len(got) == 40 and sum(r["y"] for r in got) == 30
    assert all(step(values[r["row"]]) >= high if r["y"] else step(values[r["row"]]) < low
               for r in got)
    again = {r["row"] for r in cotrain.draw(odds, "o_text", 0.75, 0.1, 40, 2).collect()}
    assert again != {r["row"] for r in got}         # a fresh draw in every round
    # rows in their order, as far as their sizes add up; the first even if it is too long
    sized = spark.createDataFrame([(i, n) for i, n in enumerate([4, 3, 9, 1])], "row int, n bigint")
    assert [r["row"] for r in cotrain._within(sized, ["row"], 9, 16).collect()] == [0, 1, 2]
    assert [r["row"] for r in cotrain._within(sized, ["row"], 2, 16).collect()] == [0, 1]
    assert [r["row"] for r in cotrain._within(sized, ["row"], 9, 2).collect()] == [0]


def test_co_training_fit_is_a_plain_logistic_fit(spark):
    """Weights of one fit, calibration and combination against direct ones, and
    scores from them by hand."""
    rng = random.Random(6)
    data = [(i, " ".join(rng.choice(["good", "fine"] if i % 2 else ["bad", "poor", "!!"])
                         for _ in range(9)), "en", "s" if i % 4 else "t", i) for i in range(80)]
    frame = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, "
                                        "n_chars bigint").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, quality int")
    seen = table(cotrain.views(frame), "seen")
    known, sample = cotrain.labelled_rows(seen, labels, "quality", 60)
    fits, platt, join = cotrain.co_train(seen, known, sample, 0.5, rounds=0)
    rows = sorted(sample.collect(), key=lambda r: r["mark"])
    y = np.array([r["y"] for r in rows], float)
    free = ~np.array([r["calibrate"] for r in rows])
    odds = []
    for k, dim in enumerate((cotrain.TEXT_DIM, cotrain.PAGE_DIM)):
        x = np.zeros((len(rows), dim))
        for i, r in enumerate(rows):
            at = np.frombuffer(r["page" if k else "at"], np.uint16)
            v = np.ones(len(at)) if k else np.log1p(np.frombuffer(r["c"], np.uint32))
            np.add.at(x[i], at, v if k else v / np.sqrt((v * v).sum()))
        full = cotrain.Sparse.dense(x)
        w = cotrain.logistic(full, y, free.astype(float), dim)
        assert np.allclose(w, fits[k], atol=1e-6)
        odds.append(x @ w[:-1] + w[-1])
    got = {r["doc_id"]: r for r in cotrain.score(seen, (fits, platt, join)).collect()}
    ids = {r["row"]: r["doc_id"] for r in seen.collect()}
    for i, r in enumerate(rows):
        p = [platt[k][0] * odds[k][i] + platt[k][1] for k in (0, 1)]
        total = 1 / (1 + np.exp(-(p[0] * join[0] + p[1] * join[1] + join[2])))
        assert got[ids[r["row"]]]["score"] == pytest.approx(total, abs=1e-6)


# ---------------------------------------------------------------- empty tables
def test_empty_tables(spark, empty):
    sized = table(mixing.sizes(empty), "e")
    mixed = mixing.mix(sized, table(mixing.targets(sized), "e"))
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    for df in (exact_dedup.groups(empty), exact_dedup.survivors(empty),
               simhash.near_duplicates(empty), simhash.survivors(empty), mixed,
               mixing.repeat(empty, table(mixed, "e")), bpe.round_trip(empty, BYTE_BPE),
               token_counts.count_tokens(empty, BYTE_BPE), licenses.scan(empty),
               quality.judge(empty, RANKS), quality.survivors(empty, RANKS),
               langid.identify(empty, F.lit(True)), lm.learn_and_score(empty, F.lit(True)),
               cotrain.classify(empty, labels)):
        assert df.count() == 0


def test_native_plans_hold_no_python(docs):
    sized = table(mixing.sizes(docs), "e")
    for df in (exact_dedup.groups(docs), exact_dedup.survivors(docs), licenses.scan(docs),
               mixing.mix(sized, table(mixing.targets(sized), "e"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


needs_data = pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")


@needs_data
def test_pipeline(spark):
    import corpus_pipeline
    from basketry.llm.common import documents
    d = "/root/testdata/sf0.001"
    docs, seen = documents(spark, d), {}
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = table(stage(spark, docs, d), "stage")
        seen[name] = (before, docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == names
    before, after = seen["exact dedup"]
    texts = [r["text"] for r in before.collect()]
    assert sorted(map(_lower, {_lower(t): t for t in texts}.values())) == sorted(
        _lower(r["text"]) for r in after.collect())
    before, after = seen["simhash near-dedup"]
    rows = sorted((r["doc_id"], _fingerprint(r["text"])) for r in before.collect())
    comp = _components([f for _, f in rows], 4)
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(
        min(i for (i, _), e in zip(rows, comp) if e == c) for c in set(comp))
    assert corpus_pipeline.run(spark, d).count() == docs.count() > 0
