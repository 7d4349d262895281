"""Fill-in-middle, collocations and decontamination against plain readings of
their definitions, on a small table with nulls, empty and long texts, ties,
repeated rows and clashing names."""

import collections
import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from basketry.llm import collocations, decontaminate, fim
from basketry.llm.common import table
from basketry.llm.queries import LOWERED

SCHEMA = ("doc_id bigint, text string, lang string, source string, n string, form string, "
          "words string, row string, h string, spans string, cut string, lead string, f bigint")


def _lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def _texts():
    rng = random.Random(5)
    vocab = "the river stone of light under a Ölberg straße x7 y".split()
    out = []
    for i in range(40):
        words = [rng.choice(vocab) for _ in range(rng.randint(1, 60))]
        text = "".join(w + rng.choice([" ", " ", " ", ", ", ". ", "\n", "\t", "! "]) for w in words)
        out.append((text, ["en", "de", None][i % 3]))
    long = " ".join(rng.choice(vocab) + rng.choice(["", "", ".\n"]) for _ in range(30000))
    out += [(None, "en"), ("", None), ("\n\n\n", "en"), (" \t ", "de"), ("one line", "en"),
            ("a <S> b\nc", "en"), ("<<P>>\n", "en"), ("x<P", "en"), (long, "en"),
            ("Ä B c d e\x00f\x1c g", "de"), ("日本語\nのテキスト\r\n한국어", "ja"),
            (".,;:!?", "en"), ("end\n", "en")]
    out += [out[3], out[3], (out[4][0], None)]
    return out


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, lang) for i, (t, lang) in enumerate(_texts())]
    return out + [out[2], out[2], (None, "no id\nat all", "en"), (None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark.createDataFrame([(*r, "s", *"nfwrhscl", 1) for r in rows],
                                       SCHEMA).repartition(3), "test-docs")


def _duck(rows, sql, items=()):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    con.execute("CREATE TABLE benchmark(item_id BIGINT, text VARCHAR)")
    if items:
        con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    return collections.Counter(tuple(sorted(zip(names, map(str, r)))) for r in found.fetchall())


def _spark(df):
    return collections.Counter(tuple(sorted((k, str(v)) for k, v in r.asDict().items()))
                               for r in df.collect())


# ---------------------------------------------------------------- fill in the middle
def _fim(text, doc_id, rate=100, spm=50, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    hexed = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexed[i:i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    if h4 % 100 < spm:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def _sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


@pytest.mark.parametrize("rate, spm, seed", [(100, 50, 7), (40, 100, 1), (0, 0, 2)])
def test_fill_in_middle(docs, rows, rate, spm, seed):
    want = collections.Counter()
    for i, t, _ in rows:
        n, form, prefix, middle, out = _fim(t, i, rate, spm, seed)
        want[(i, n, form, prefix, middle, _sha(out), _sha(t or ""), out)] += 1
    got = fim.transform(docs, seed, rate, spm)
    assert collections.Counter(tuple(r) for r in got.collect()) == want
    back = collections.Counter(tuple(r) for r in fim.restore(got).collect())
    assert back == collections.Counter((i, t or "") for i, t, _ in rows)


def test_fill_in_middle_sql(docs, rows):
    assert _spark(fim.transform(docs, texts=False)) == _duck(rows, fim.sql())


def test_fill_in_middle_small_batches(docs, rows, monkeypatch):
    monkeypatch.setattr(fim, "BATCH", 100)
    assert fim.transform(docs).count() == len(rows)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab<PSM>\nä", max_size=30), st.integers(0, 50), st.sampled_from([0, 50, 100]))
def test_pieces_round_trip(text, doc_id, spm):
    raw = text.encode()
    n, form, pieces, prefix, middle = fim.arrange(raw, doc_id, 7, 100, spm)
    want = _fim(text, doc_id, 100, spm)
    assert (n, form, prefix, middle, pieces.join().decode()) == want
    assert pieces.sha256() == _sha(want[-1])
    assert fim.restored(pieces.join(), form).join() == raw
    if form != "plain":                 # the descriptors alone give it back as well
        back = pieces.arranged(fim.inverse(fim.FORMS[form]))
        assert back.first(3).join() == raw and all(r[0] == fim.TEXT for r in back.rows[:3])


def test_pieces_cut_and_permute():
    p = fim.Pieces.of(b"abcdef").cut(0, 2, 2, 6)
    assert [bytes(x) for x in p.stream()] == [b"", b"ab", b"", b"cdef", b""]
    q = p.cut(1, 3)
    assert [bytes(x) for x in q.stream()] == [b"", b"a", b"b", b"", b"c", b"def", b""]
    order = [3, 0, 4, 2, 5, 1, 6]
    assert q.arranged(order).arranged(fim.inverse(order)).rows == q.rows
    with pytest.raises(ValueError):
        fim.restored(b"<P>ab<S>cd", "psm")
    for bad in ((b"<P>", b"<P>>", b"<M>"), (b"ab", b"bc", b"x"), (b"", b"a", b"b")):
        with pytest.raises(ValueError):
            fim.check_marks(bad)


# ---------------------------------------------------------------- collocations
def _counts(rows):
    n, f = collections.Counter(), collections.Counter()
    for _, t, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0A-\x0D]", _lower(t)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    return n, f


def _collocations(rows, least, limit, percent):
    n, f = _counts(rows)
    found = collections.defaultdict(list)
    cand = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    for (lang, p), a in cand.items():
        best = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        inside = any(lo == lang and len(q) > len(p) and 100 * b >= percent * a
                     and any(q[i:i + len(p)] == p for i in range(len(q)))
                     for (lo, q), b in cand.items())
        if not inside:
            k = best[1]
            found[lang].append((-best[0], -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    out = collections.Counter()
    for lang, rows_ in found.items():
        for rank, (s, a, p, left, right) in enumerate(sorted(rows_)[:limit], 1):
            out[(lang, rank, p.decode(), -a, left, right, n[lang], -s)] += 1
    return out


@pytest.mark.parametrize("least, limit, percent", [(3, 2000, 80), (30, 15, 60), (1, 40, 100)])
def test_collocations(docs, rows, least, limit, percent):
    few = [r for r in rows if len(r[1] or "") < 5000] if least == 1 else rows
    frame = docs.where(F.coalesce(F.length("text"), F.lit(0)) < 5000) if least == 1 else docs
    got = collections.Counter(tuple(r) for r in collocations.collocations(
        frame, least, limit, percent).collect())
    assert got == _collocations(few, least, limit, percent) and len(got) > 10


def test_collocations_sql(docs, rows):
    assert _spark(collocations.collocations(docs, 5, 50)) == _duck(
        rows, collocations.sql(LOWERED, 5, 50))


@pytest.mark.parametrize("shards, bits, piece", [(1, 1 << 27, 4 << 20), (7, 1 << 19, 3000),
                                                 (3, 1 << 20, 50)])
def test_collocations_in_any_partitioning(docs, rows, monkeypatch, shards, bits, piece):
    """Shards, full bit sets and short slices change the work, not the result."""
    monkeypatch.setattr(collocations, "SHARDS", shards)
    monkeypatch.setattr(collocations, "SALTS", shards)
    monkeypatch.setattr(collocations, "SLICE", piece)
    monkeypatch.setattr(collocations, "BITS", bits)
    got = collections.Counter(tuple(r) for r in collocations.collocations(docs, 4, 300).collect())
    assert got == _collocations(rows, 4, 300, 80)


def test_local_support_is_complete(docs, rows):
    """Every phrase that reaches the support is in the union of the shards."""
    sets = collocations.mine(docs, 5)
    n, f = _counts(rows)
    totals = collocations.frequent(docs, 5)[1]
    assert {r["lang"]: r["n"] for r in totals.collect()} == {k: v for k, v in n.items() if v}
    for (lang, p), a in f.items():
        if a >= 5:
            c = collocations.Chunk([" ".join(p).encode()], collocations._seed(lang))
            assert collocations.has(sets[len(p) - 1], c.hashes(len(p), np.array([0]))).all()


def test_slices_end_at_pieces():
    text = b"aa bb cc dd ee, ff gg. hh ii jj kk ll mm nn oo!pp"
    parts = list(collocations.slices(text, 10))
    assert b"".join(parts) == text and len(parts) > 2
    assert all(p[-1:] in b".,!" for p in parts[:-1])
    assert list(collocations.slices(b"")) == [b""]


def test_words_of_a_chunk():
    c = collocations.Chunk([b"The  cat\tsat. On", b"", b"the cat"], 1)
    assert [c.word(i) for i in range(6)] == [b"the", b"cat", b"sat", b"on", b"the", b"cat"]
    assert c.codes[0] == c.codes[4] and c.codes[1] == c.codes[5] and len(set(c.codes)) == 4
    assert c.piece[0] == c.piece[2] != c.piece[3] != c.piece[4]


# ---------------------------------------------------------------- decontamination
def _words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(t))


def _hits(words, items, n):
    hit, found = set(), set()
    for item, text in items:
        w = _words(text)
        width = min(n, len(w))
        grams = {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if w else set()
        for i in range(len(words) - width + 1 if grams else 0):
            if tuple(words[i:i + width]) in grams:
                hit |= set(range(i, i + width))
                found.add(item)
    return hit, found


@pytest.fixture(scope="module")
def leaks(rows):
    """Documents with passages of the items, and items with nulls, short and
    repeated texts, shared windows and repeated ids."""
    rng = random.Random(9)
    passage = [" ".join(f"w{rng.randrange(400)}" for _ in range(25)) for _ in range(4)]
    items = [(1, passage[0]), (2, passage[1].upper()), (3, passage[0] + " tail"), (10, passage[2]),
             (10, passage[3]), (4, None), (5, "..."), (6, "Solo-Wort"), (7, "unique"),
             (None, "kein id hier"), (2, passage[1]), (8, "straße straße straße straße")]
    cut = passage[0].split()
    texts = [passage[0], "before, " + passage[1].replace(" ", ", ") + "; after", " ".join(cut[:10]),
             " ".join(cut[:9]), " ".join(cut[3:14]), "Solo wort! solo wort", "UNIQUE", "x",
             "kein id hier", " ".join(cut[:5] + ["break"] + cut[5:]), "straße " * 9,
             f"{passage[2]} ... {passage[2]}\n{passage[3]}", "«" + passage[1] + "»",
             "lead in " + " ".join(cut[:14]) + " and " + " ".join(cut[8:]) + " out"]
    docs = rows + [(1000 + i, t, "en") for i, t in enumerate(texts)]
    docs += [docs[-1], (None, passage[3], "en")]
    return docs, items


@pytest.fixture(scope="module")
def leaky(spark, leaks):
    docs, items = leaks
    frame = spark.createDataFrame([(*r, "s", *"nfwrhscl", 1) for r in docs], SCHEMA).repartition(3)
    bench = spark.createDataFrame([(i, t, "x", "y") for i, t in items],
                                  "item_id bigint, text string, h string, gram string")
    return table(frame, "leaky"), table(bench, "bench")


def _digest(found):
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated")


@pytest.mark.parametrize("n", [10, 3, 1])
def test_decontamination_scan(leaks, leaky, n):
    docs, items = leaks
    want = collections.Counter()
    for i, t, _ in docs:
        w = _words(t)
        hit, found = _hits(w, items, n)
        names = sorted(str(x) for x in found if x is not None)
        want[(i, len(w), len(hit), len(names), _sha(",".join(names)), bool(hit))] += 1
    got = decontaminate.scan(*leaky, n)
    assert collections.Counter(tuple(r) for r in _digest(got).collect()) == want
    assert sum(c for k, c in want.items() if k[-1]) > 10


def test_decontamination_sql(leaks, leaky):
    docs, items = leaks
    assert _spark(_digest(decontaminate.scan(*leaky, 10))) == _duck(
        docs, decontaminate.sql(LOWERED), items)


def test_decontamination_beyond_the_bounds(leaky, monkeypatch):
    """A full bit set and a table too large to broadcast change no result."""
    want = _spark(_digest(decontaminate.scan(*leaky, 10)))
    monkeypatch.setattr(decontaminate, "LEAST_BITS", 64)
    monkeypatch.setattr(decontaminate, "MOST_BITS", 64)
    monkeypatch.setattr(decontaminate, "MOST_BYTES", 0)
    assert _spark(_digest(decontaminate.scan(*leaky, 10))) == want


def test_decontamination_removes(leaks, leaky):
    docs, items = leaks
    spans = decontaminate.clean(*leaky, 10, "spans")
    assert spans.columns == leaky[0].columns
    got = collections.Counter((r["doc_id"], r["text"]) for r in spans.collect())
    want = collections.Counter()
    sep = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    for i, t, _ in docs:
        hit, _found = _hits(_words(t), items, 10)
        if hit:
            units = re.findall(rf"^{sep}+|[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+{sep}*", t)
            lead = bool(re.match(sep, t))
            t = "".join(u for j, u in enumerate(units) if j - lead not in hit)
        want[(i, t)] += 1
    assert got == want
    left = decontaminate.clean(*leaky, 10, "documents")
    assert collections.Counter((r["doc_id"], r["text"]) for r in left.collect()) == \
        collections.Counter((i, t) for i, t, _ in docs if not _hits(_words(t), items, 10)[0])
    half = decontaminate.clean(*leaky, 10, "documents", 0.5)
    assert collections.Counter((r["doc_id"], r["text"]) for r in half.collect()) == \
        collections.Counter((i, t) for i, t, _ in docs
                            if 2 * len(_hits(_words(t), items, 10)[0]) <= len(_words(t)))
    with pytest.raises(ValueError):
        decontaminate.clean(*leaky, 10, "words")


def test_decontamination_holds_no_python(leaky):
    for df in (decontaminate.scan(*leaky), decontaminate.clean(*leaky)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


# ---------------------------------------------------------------- empty tables
def test_empty_tables(spark, docs, leaky):
    none = spark.createDataFrame([], SCHEMA)
    no_items = spark.createDataFrame([], "item_id bigint, text string")
    assert fim.transform(none).count() == fim.restore(fim.transform(none)).count() == 0
    assert collocations.collocations(none).count() == 0
    assert decontaminate.scan(none, leaky[1]).count() == 0
    assert decontaminate.clean(none, leaky[1]).count() == 0
    clean = decontaminate.scan(docs, no_items).collect()
    assert len(clean) == docs.count() and not any(r["contaminated"] for r in clean)
    assert decontaminate.clean(docs, no_items).count() == docs.count()
