"""Sharding, collocations and periodic runs against plain versions of themselves."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from kindred.llm import collocations, periodic, sharding
from kindred.llm.common import table

from .conftest import prose

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 100, 4097, 70_000])
def test_permutation_and_its_inverse(n):
    p = sharding.Permutation(n, seed=n)
    rows = np.arange(n)
    places = p.place(rows)
    assert sorted(places.tolist()) == rows.tolist() and p.row(places).tolist() == rows.tolist()
    assert [int(p.place(np.array([r]))[0]) for r in range(min(n, 50))] == places[:50].tolist()
    if n > 4000:
        assert np.mean(places == rows) < 0.01 and places.tolist() != sharding.Permutation(n, seed=n + 1).place(rows).tolist()
        assert abs(np.corrcoef(rows, places)[0, 1]) < 0.1 and abs(np.corrcoef(places[1:], places[:-1])[0, 1]) < 0.1


def test_large_numbers_walk_too():
    p = sharding.Permutation((1 << 61) + 12345)
    rows = np.array([0, 1, (1 << 61) + 12344, 987654321987654321])
    assert p.row(p.place(rows)).tolist() == rows.tolist() and (p.place(rows) < p.n).all()


def check_shards(rows, n, shards):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert len(rows) == n and max(map(len, slots.values())) - min(len(slots[k]) for k in range(shards)) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op11_over_a_table(spark):
    docs = table(spark, SF, "documents")
    rows = sharding.op11_sharding(docs).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    check_shards(rows, len(texts), 24)
    p = sharding.Permutation(len(texts))
    for k, r in enumerate(sorted(rows, key=lambda r: r.doc_id)):
        place = int(p.place(np.array([k]))[0])
        assert (r.row, r.shard, r.slot) == (k, place % 24, place // 24) and r.law == "rows" and r.grown_shard is None
        assert r.size == len(texts[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
    again = sharding.op11_sharding(docs.repartition(7)).collect()
    assert set(rows) == set(again)


def test_sharding_of_odd_tables(spark, odd_docs, clashing):
    rows = sharding.op11_sharding(odd_docs).collect()
    check_shards(rows, 10, 24)
    assert sum(r.size == 8 and r.text_crc32 == 0 for r in rows) == 3
    out = sharding.assign(clashing.withColumn("KD_ROW", sharding.F.lit("x")), 4)
    assert out.columns == [*clashing.columns, "kd_row", "kd_shard", "kd_slot"] and sorted(r.kd_row for r in out.collect()) == list(range(6))
    assert sharding.op11_sharding(odd_docs.limit(0)).count() == 0
    equal = spark.createDataFrame([(None, "same")] * 5000, "doc_id long, text string").repartition(3)
    check_shards(sharding.op11_sharding(equal).collect(), 5000, 24)


def test_shard_files(spark, tmp_path):
    docs = table(spark, SF, "documents")
    path = f"file://{tmp_path}/shards"
    sharding.write_shards(docs, path, 5)
    want = {(r.kd_shard, r.kd_slot): r.doc_id for r in sharding.assign(docs, 5).collect()}
    for shard in range(5):
        rows = sharding.read_shard(spark, path, shard).collect()
        assert [r.doc_id for r in rows] == [want[shard, k] for k in range(len(rows))] and len(rows) == sum(s == shard for s, _ in want)
    assert [r.doc_id for r in sharding.read_shard(spark, path, 3, 4, 9).collect()] == [want[3, k] for k in range(4, 9)]


def brute_collocations(docs, s=collocations.Settings()):
    """docs: (lang, text) pairs. Phrase by phrase, with whole numbers of any size; every longer candidate is looked at."""
    counts, words = defaultdict(Counter), Counter()
    for lang, text in docs:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang or "und"] += len(w)
            for k in range(1, s.words + 1):
                counts[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= s.least}
        gone = {q[i : i + k] for q, b in candidates.items() for k in range(2, len(q)) for i in range(len(q) - k + 1) if 100 * b >= s.inside * candidates[q[i : i + k]]}
        rows = []
        for p, a in candidates.items():
            if p not in gone:
                score, _, l, r = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, phrase.decode(), -a, l, r, words[lang], -score) for i, (score, a, phrase, l, r) in enumerate(sorted(rows)[: s.top])]
    return sorted(out)


def collocated(df, s=collocations.Settings()):
    out = collocations.collocations(df, s)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, out.collect()))


def test_collocations_of_a_table(spark):
    docs = table(spark, SF, "documents")
    want = brute_collocations([(r.lang, r.text) for r in docs.collect()])
    assert len(want) > 50 and sorted(map(tuple, collocations.op12_collocations(docs).collect())) == want


@pytest.mark.parametrize("s", [collocations.Settings(words=4, least=2, inside=60, top=30), collocations.Settings(words=2, least=1, top=5), collocations.Settings(words=5, least=3, inside=100)])
def test_collocations_of_invented_texts(spark, s):
    r = random.Random(5)
    marks = [" ", " ", " ", "  ", "\t", ", ", "\n", ". ", " ", "\x0b", "!"]
    texts = [(r.choice(["en", "de", None]), "".join(r.choice(["a", "B", "b", "Ä", "ä", "\U0001f600", "ab", "a-b", "'"]) + r.choice(marks) for _ in range(r.randrange(80)))) for _ in range(60)]
    df = spark.createDataFrame(texts, "lang string, text string").repartition(5)
    assert collocated(df, s) == brute_collocations(texts, s)


def test_collocations_of_odd_tables(spark, odd_docs):
    rows = [(None, None), ("en", ""), ("en", "... \n"), ("en", "x y " * 40_000), ("en", "x y"), ("en", "x y"), (None, "p q r " * 12), ("fr", "ß " * 11), ("x\ny z", "k l m " * 11)]
    df = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 as gram", "2 as n", "'z' as phrase")
    assert collocated(df) == brute_collocations(rows)
    assert collocated(df.limit(0)) == [] and collocated(df.where("text = ''")) == []
    assert collocations.collocations(odd_docs.withColumn("lang", collocations.F.col("doc_id"))).count() == 0


def test_steps_cut_between_texts_only(spark):
    body = ["one two. three", "two three four", "", "four"]
    words, piece = collocations._words_of(np.frombuffer("".join(body).encode(), np.uint8), np.array([0, 14, 28, 28]))
    assert words.to_pylist() == [b"one", b"two", b"three", b"two", b"three", b"four", b"four"]
    assert [piece[i] == piece[i + 1] for i in range(6)] == [True, False, False, True, True, False]


def test_ngrams_of_a_step_are_numbers_until_they_go_out(spark, monkeypatch):
    runs = []
    monkeypatch.setattr(collocations, "mapped", lambda df, run, schema: runs.append(run))
    collocations.grams(spark.createDataFrame([], "lang string, text string"), 3)
    r = random.Random(7)
    text = " ".join(str(r.randrange(100_000)) for _ in range(1_500_000))
    batch = pa.record_batch([pa.array(["en"]), pa.array([text])], ["lang", "body"])
    usual, pool = pa.default_memory_pool(), pa.proxy_memory_pool(pa.default_memory_pool())
    pa.set_memory_pool(pool)
    tracemalloc.start()
    try:
        most = max(tracemalloc.get_traced_memory()[0] + pool.bytes_allocated() for _ in runs[0](iter([batch])))
        peak = tracemalloc.get_traced_memory()[1] + pool.max_memory()
    finally:
        tracemalloc.stop()
        pa.set_memory_pool(usual)
    assert most < 12 * len(text) and peak < 20 * len(text)


def brute_runs(words, least=24, copies=3):
    """All (start, length, period), by trying each period at each place."""
    out = {}
    n = len(words)
    for q in range(1, n // copies + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            e = i
            while e + q < n and words[e] == words[e + q]:
                e += 1
            if e - i + q >= max(least, copies * q):
                out.setdefault((i, e - i + q), q)
            i = e + 1
    return sorted((s, length, q) for (s, length), q in out.items())


def brute_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = brute_runs(w)
    best = min(runs, key=lambda r: (-(10**12 * r[1] // r[2]), r[0], r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    tail = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *tail, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def key(row):
    return tuple((x is not None, x) for x in row)


def test_op13_over_a_table(spark):
    docs = table(spark, SF, "documents")
    got = periodic.op13_periodic(docs)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = [r for r in docs.collect() if len((r.text or "").split()) < 3000]
    want = sorted((brute_row(r.doc_id, r.text) for r in rows), key=key)
    ids = {r.doc_id for r in rows}
    assert sum(w[1] > 0 for w in want) > 5 and sorted((tuple(r) for r in got.collect() if r.doc_id in ids), key=key) == want


def texts_with_runs(seed):
    r = random.Random(seed)
    out = []
    for _ in range(60):
        words = []
        for _ in range(r.randrange(1, 6)):
            base = [r.choice("abcdefgh"[: r.randrange(1, 9)]) for _ in range(r.randrange(1, 30))]
            words += base * r.randrange(1, 9) + base[: r.randrange(len(base) + 1)] + [r.choice("abxyz") for _ in range(r.randrange(30))]
        out.append("  ".join(words))
    return out


@pytest.mark.parametrize("heavy", [None, 0, 3, 10**6])
def test_runs_by_heavy_and_light_words(spark, monkeypatch, heavy):
    """The same runs whatever counts as heavy: all words by transforms, all by pairs, or some by each."""
    if heavy is not None:
        monkeypatch.setattr(periodic, "heavy_from", lambda n: np.full(len(n), heavy))
    texts = texts_with_runs(heavy or 7)
    s = periodic.Settings()
    words = [t.split() for t in texts]
    ids = {w: i for i, w in enumerate(sorted({x for own in words for x in own}))}
    number = np.array([ids[x] for own in words for x in own])
    ends = np.cumsum([len(w) for w in words])
    counts, first = periodic.lag_counts(number, ends, s)
    for t, own in enumerate(words):
        top = len(own) // 3 if len(own) >= 24 else 0
        mine = counts[first[t] : first[t] + top + 1]
        assert [int(mine[q]) for q in range(1, top + 1)] == [sum(x == y for x, y in zip(own, own[q:], strict=False)) for q in range(1, top + 1)]
        assert periodic.runs_of(number[ends[t] - len(own) : ends[t]], mine.copy(), s) == brute_runs(own)


def test_runs_of_odd_tables(spark, odd_docs, clashing):
    rows = [*((None, "w " * 30), (1, "x y \x0b z " * 20), (6, prose(3, 4) + " " + "p q r " * 500), (7, "same " * 50_000))]
    df = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    plain = [(r.doc_id, r.text) for r in df.collect() if len(r.text or "") < 10_000]
    got = periodic.op13_periodic(df.where("text is null or length(text) < 10000")).collect()
    assert sorted(map(tuple, got), key=key) == sorted((brute_row(*r) for r in plain), key=key)
    long = {r.doc_id: r for r in periodic.find_runs(df.where("length(text) >= 10000")).collect()}
    assert long[7].kd_runs == [(0, 50_000, 1)] and long[7].kd_collapsed == "same" and long[5].kd_runs == [] and long[5].kd_words == 30_000
    new = ["kd_words", "kd_runs", "kd_strongest", "kd_collapsed"]
    out = periodic.find_runs(clashing.withColumn("KD_RUNS", periodic.F.lit("x")))
    assert out.columns == [*(c for c in clashing.columns if c.lower() not in new), *new]
    assert out.count() == 6 and periodic.op13_periodic(odd_docs.limit(0)).count() == 0


def test_strongest_is_exact():
    assert periodic.strongest([(0, 100, 33), (5, 300, 99), (1, 303, 100)]) == (0, 100, 33) and periodic.strongest([(0, 10**15, 3), (1, 10**15 + 1, 3)]) == (1, 10**15 + 1, 3) and periodic.strongest([]) is None
