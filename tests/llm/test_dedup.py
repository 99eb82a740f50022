"""Near-dedup, line dedup and decontamination against brute force."""

import random
import time

import duckdb
import numpy as np
import pytest

from kindred.llm import decontaminate, graph, line_dedup, minhash

from .conftest import prose


def shingles(text, k=3):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute_components(docs, k=3, percent=85):
    ids = sorted(docs)
    sets, parent = {i: shingles(docs[i], k) for i in ids}, {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for j, a in enumerate(ids):
        for b in ids[:j]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def near_copies():
    """A hub with many edited copies (most pairs of copies are below the threshold), chains, exact copies and singles."""
    r, docs = random.Random(3), {}
    base = prose(5, 200).split()
    for i in range(60):
        words = list(base)
        for _ in range(r.randrange(0, 9)):
            words[r.randrange(200)] = f"edit{r.randrange(10**6)}"
        docs[i * 3 + 100] = " ".join(words)
    chain = prose(6, 120).split()
    for i in range(12):
        chain = [*chain[3:], *(f"c{i}w{k}" for k in range(3))]
        docs[2000 + i] = " ".join(chain)
    for i in range(40):
        docs[3000 + i] = prose(7 + i % 30, 60)
    return docs | {5: "two words", 6: "TWO words", 7: "two", 8: "", 9: "\n"}


def test_near_groups_equal_brute_force(spark):
    docs = near_copies()
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    small = minhash.Settings(block=16)
    got = {r.id: (r.n, r.component) for r in minhash.near_groups(df, small).collect()}
    want = brute_components(docs)
    assert got == {i: (len(shingles(t)), want[i]) for i, t in docs.items()}
    assert {r.doc_id for r in minhash.drop_near_copies(df, small).collect()} == {i for i in docs if want[i] == i}


def test_near_groups_of_odd_rows(spark, odd_docs):
    rows = [tuple(r) for r in minhash.op1_minhash(odd_docs).collect()]
    assert len(rows) == 10 and all(r[3] for r in rows) and sum(r[0] is None and r[2] is None for r in rows) == 2
    assert minhash.near_groups(odd_docs.limit(0)).count() == 0 and minhash.drop_near_copies(odd_docs).columns == odd_docs.columns


def near_border(count, n, edits, seed):
    """Texts of n words that differ from one another in a few places each, so similarities lie around the threshold."""
    r, base = random.Random(seed), prose(seed, n).split()
    out = []
    for _ in range(count):
        words = list(base)
        for _ in range(r.randrange(edits)):
            words[r.randrange(n)] = f"e{r.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_what_leaders_leave_open_meets_all_others(spark):
    """One leader round, then small blocks and tiles; and rounds as long as they join anything."""
    docs = dict(enumerate([*near_border(60, 150, 9, 21), *near_border(40, 80, 5, 22), prose(23, 50)]))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    want = brute_components(docs)
    assert 1 < sum(want[i] == i for i in docs) < 60
    for s in (minhash.Settings(block=4, meets=1000), minhash.Settings(tile=3000, meets=0)):
        assert {r.id: r.component for r in minhash.near_groups(df, s).collect()} == want


def test_rows_of_one_id_are_one_document(spark):
    """Each text of an id carries on what the other links to; the docstring's rule."""
    a, b = prose(31, 60), prose(32, 60)
    rows = [(3, a), (5, a), (5, b), (7, b), (9, ""), (9, None), (11, None), (11, b), (None, prose(33, 60))]
    got = sorted(((r.id, r.n, r.component) for r in minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(3, 58, 3), (5, 58, 3), (5, 58, 3), (7, 58, 3), (9, 0, 9), (9, 0, 9), (11, 0, 3), (11, 58, 3), (None, 58, None)], key=str)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows[:-1])
    assert sorted(con.execute(f"SELECT doc_id, n_shingles, component_id FROM ({minhash.OP1_SQL})").fetchall(), key=str) == [g for g in got if g[0] is not None]


def test_ids_may_be_strings(spark):
    docs = {f"d{i}": t for i, t in near_copies().items()}
    df = spark.createDataFrame(list(docs.items()), "doc_id string, text string").repartition(3)
    assert {r.id: r.component for r in minhash.near_groups(df).collect()} == brute_components(docs)


def test_components_of_a_hub(spark):
    """A node of more edges than `hub_edges` hands out its label by broadcast; the others join."""
    r = random.Random(3)
    edges = [("m", f"{i:03}") for i in range(300)] + [(f"x{r.randrange(40)}", f"x{r.randrange(40)}") for _ in range(30)]
    want = {r.node: r.comp for r in graph.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    got = {r.node: r.comp for r in graph.components(spark.createDataFrame(edges, "a string, b string"), hub_edges=5).collect()}
    assert got == want and got["m"] == "000" and len({got[f"{i:03}"] for i in range(300)}) == 1


def test_signatures_estimate_and_end_early():
    a, b = np.arange(1, 501, dtype=np.uint64), np.arange(101, 601, dtype=np.uint64)
    x, y = minhash.super_minhash([minhash.mixed(a), minhash.mixed(b)], 256)
    assert abs((x == y).mean() - 400 / 600) < 0.1 and (x < 1 << 40).all()
    tiny = minhash.super_minhash([np.array([7], np.uint64), np.zeros(0, np.uint64)], 16)
    assert sorted(v >> 32 for v in tiny[0].tolist()) == list(range(16)) and (tiny[1] == np.iinfo(np.int64).max).all()


def test_components_of_a_long_path(spark):
    edges = [(f"{i:04}", f"{i + 1:04}") for i in range(60)] + [("9000", "9001")]
    got = {r.node: r.comp for r in graph.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {f"{i:04}": "0000" for i in range(61)} | {"9000": "9000", "9001": "9000"}


def brute_lines(docs):
    seen, out = {}, {}
    for i, t in sorted(docs.items()):
        lines = t.split("\n")
        at = [k for k, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")]
        gone = set()
        for k in range(len(at) - 2):
            w = tuple(lines[p] for p in at[k : k + 3])
            if w in seen:
                gone.update(at[k : k + 3])
            seen.setdefault(w, (i, k))
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_line_dedup_equals_brute_force(spark):
    r = random.Random(1)
    docs = {i: "\n".join(r.choice(["a", "b", "", "c d", "  "]) if r.random() < 0.6 else f"line {r.randrange(50)}" for _ in range(r.randrange(0, 14))) for i in range(60)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    out = line_dedup.dedup_lines(df)
    assert {x.doc_id: x.text for x in out.collect()} == brute_lines(docs)
    plan = line_dedup.op7_line_dedup(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_line_dedup_of_odd_rows(odd_docs):
    out = line_dedup.dedup_lines(odd_docs)
    rows = sorted(map(tuple, out.select("doc_id", "text").collect()), key=str)
    assert out.columns[:-2] == odd_docs.columns and rows == sorted(map(tuple, odd_docs.select("doc_id", "text").collect()), key=str)
    assert line_dedup.dedup_lines(odd_docs.limit(0)).count() == 0


def test_line_dedup_is_linear_in_lines(spark):
    """Two texts of 50,000 lines that share their last ones."""
    docs = {i: "\n".join([f"{i} {k}" for k in range(50_000)] + ["a", "b", "c", "d"]) for i in (1, 2)}
    df, began = spark.createDataFrame(list(docs.items()), "doc_id long, text string"), time.time()
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    assert got == {1: docs[1], 2: docs[2].removesuffix("\na\nb\nc\nd")} and time.time() - began < 60


def test_clashing_columns(clashing):
    lines = line_dedup.dedup_lines(clashing)
    assert lines.columns == [c for c in clashing.columns if c not in ("kd_lines", "kd_removed")] + ["kd_lines", "kd_removed"]
    assert {tuple(r)[2:-2] for r in lines.collect()} == {("x",) * (len(clashing.columns) - 4)} and lines.where("kd_lines = 2").count() == 6
    kept = minhash.drop_near_copies(clashing)
    assert kept.columns == clashing.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2]
    bench = clashing.sparkSession.createDataFrame([(1, prose(1, 70))], "item_id long, text string")
    rest = decontaminate.drop_contaminated(clashing, bench)
    assert rest.columns == clashing.columns and sorted(r.doc_id for r in rest.collect()) == [0, 2, 3, 5]


def brute_tiles(doc, item, least):
    md, mi, total = [False] * len(doc), [False] * len(item), 0
    while True:
        best, found = least - 1, []
        for i in range(len(item)):
            for d in range(len(doc)):
                k = 0
                while i + k < len(item) and d + k < len(doc) and item[i + k] == doc[d + k] and not mi[i + k] and not md[d + k]:
                    k += 1
                if k > best:
                    best, found = k, [(i, d)]
                elif k == best and k >= least:
                    found.append((i, d))
        if best < least:
            return total
        for i, d in found:
            if not any(mi[i : i + best]) and not any(md[d : d + best]):
                md[d : d + best] = mi[i : i + best] = [True] * best
                total += best


def test_tiles_equal_brute_force():
    r = random.Random(2)
    for _ in range(60):
        item = [r.randrange(6) for _ in range(r.randrange(3, 25))]
        doc = [r.randrange(6) for _ in range(r.randrange(3, 40))]
        got = decontaminate.tiles(np.array(doc, np.uint64), np.array(item, np.uint64), 3)
        assert sum(n for _, _, n in got) == brute_tiles(doc, item, 3)
        assert all(doc[d : d + n] == item[i : i + n] for d, i, n in got)


def test_decontamination(spark, odd_docs):
    items = [(1, prose(50, 40)), (2, "two words"), (3, None), (4, ""), (5, prose(51, 30))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    own = items[0][1].split()
    texts = {10: "x " + items[0][1].upper() + " y", 11: " ".join(own[20:] + ["between"] * 3 + own[:20]), 12: " ".join(own[:15]), 13: "has two, words here", 14: prose(60, 80), 15: "two other words"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for size in (16_000_000, 10):
        got = {r.doc_id: (r.item_id, r.contaminated) for r in decontaminate.op10_decontaminate(df, bench, decontaminate.Settings(block_chars=size)).collect()}
        assert got == {10: (1, True), 11: (1, True), 12: (None, False), 13: (2, True), 14: (None, False), 15: (None, False)}
    assert decontaminate.op10_decontaminate(odd_docs, bench).where("contaminated").count() == 0
    assert decontaminate.op10_decontaminate(df, bench.limit(0)).where("contaminated").count() == 0 and decontaminate.drop_contaminated(df, bench).columns == df.columns


def test_items_with_a_null_id_convict(spark):
    items, own = [(None, prose(52, 40)), (None, prose(53, 40)), (7, prose(52, 40) + " more")], prose(54, 80)
    df = spark.createDataFrame([(1, f"x {items[0][1]} y"), (2, f"{items[1][1]} {own}"), (3, own)], "doc_id long, text string")
    for kind, name in (("long", 7), ("string", "7")):
        bench = spark.createDataFrame([(i and name, t) for i, t in items], f"item_id {kind}, text string")
        got = {r.doc_id: (r.item_id, r.n_items, r.contaminated, r.kept) for r in decontaminate.op10_decontaminate(df, bench).collect()}
        assert got == {1: (None, 2, True, False), 2: (None, 1, True, False), 3: (None, 0, False, True)}
        assert [r.doc_id for r in decontaminate.drop_contaminated(df, bench.where("item_id is null")).collect()] == [3]


def test_early_bounds_lose_nothing(spark):
    """Items that share a frequent phrase: rare seeds and reach leave out pairs that can't convict, and no others."""
    r, phrase = random.Random(8), "answer the following question about the text below now"
    items = [(i, f"{phrase} {prose(200 + i, r.randrange(3, 30))}" if i % 3 else phrase) for i in range(30)]
    docs = [(i, " ".join([phrase, prose(300 + i, 10), *(" ".join(t.split()[r.randrange(9) :]) for _, t in r.sample(items, 2))])) for i in range(40)]
    bench, df, s = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string").repartition(3), decontaminate.Settings()
    want = {(x.id, x.item): x.covered for x in decontaminate.tilings(df, bench).collect() if 100 * x.covered >= s.percent * x.words}
    some = decontaminate.tilings(df, bench, s, percent=s.percent)
    assert {(x.id, x.item): x.covered for x in some.collect() if 100 * x.covered >= s.percent * x.words} == want and len(want) > 50
    words = {i: t.lower().split() for i, t in [*docs, *((1000 + i, t) for i, t in items)]}
    brute = {(d, i): brute_tiles(words[d], words[1000 + i], 5) for d in range(6) for i in range(30)}
    assert {k: v for k, v in brute.items() if 100 * v >= 50 * len(words[1000 + k[1]])} == {k: v for k, v in want.items() if k[0] < 6}


@pytest.mark.parametrize("k", [1, 2, 5])
def test_rolling_hashes(k):
    h = np.array([5, 9, 5, 9, 5, 9, 1], np.uint64)
    r = decontaminate.rolling(h, k).tolist()
    runs = [tuple(h[i : i + k].tolist()) for i in range(len(h) - k + 1)]
    assert len(r) == len(runs) and all((r[i] == r[j]) == (runs[i] == runs[j]) for i in range(len(r)) for j in range(len(r)))


def test_rows_of_a_null_id_are_judged_by_their_own_text(spark):
    item, other = prose(200, 40), prose(201, 60)
    bench = spark.createDataFrame([(1, item), (2, other)], "item_id long, text string")
    rows = [(None, "before " + item + " after"), (None, prose(202, 80)), (None, None), (None, ""), (None, other), (None, other), (5, item), (6, prose(203, 50))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("*", "'x' as mark", "'y' as KD_MARK")
    got = sorted(((r.doc_id or 0), r.item_id or 0, r.n_items, r.contaminated, r.kept) for r in decontaminate.op10_decontaminate(df, bench).collect())
    assert got == sorted([(0, 1, 1, True, False), (0, 2, 1, True, False), (0, 2, 1, True, False), (0, 0, 0, False, True), (0, 0, 0, False, True), (0, 0, 0, False, True), (5, 1, 1, True, False), (6, 0, 0, False, True)])
    rest = decontaminate.drop_contaminated(df, bench)
    assert rest.columns == df.columns and sorted((r.text or "") for r in rest.collect()) == sorted(t or "" for t in (rows[1][1], None, "", rows[7][1]))
