"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full shingle sets, and union of links."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import discard, fresh, mapped, mixed, slices, written
from kindred.llm.graph import components

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_SHORT = 0x27D4EB2F165667C5


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's k-word shingles: words are runs without ASCII white space, A-Z lower-cased.

    A text of fewer words has its whole sequence as one shingle; one without words or a null text has none.
    """
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        hashes.extend(map(xxhash.xxh3_64_intdigest, words))
        counts[i] = len(words)
    h = np.array(hashes, np.uint64)
    n = max(0, len(h) - k + 1)
    s = np.zeros(n, np.uint64)
    for j in range(k):
        s = mixed((s ^ h[j : n + j]) * _A + _B)
    ends = np.cumsum(counts)
    out = []
    for count, end in zip(counts.tolist(), ends.tolist(), strict=True):
        if count >= k:
            out.append(np.unique(s[end - count : end - k + 1]))
        else:
            out.append(np.array([xxhash.xxh3_64_intdigest(h[end - count : end].tobytes(), _SHORT + count)] if count else [], np.uint64))
    return out


def super_minhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures (a row a set) of m values; an empty set has all ones.

    Each element deals ranks 0 to m-1 to the places in a random order of its own and adds a random fraction to each; a place keeps
    the least sum. Ranks are dealt to all sets at once, one after the other; a set stops as soon as all its places are filled, as later ranks
    can't be less.
    """
    size = np.array([len(x) for x in sets], np.int64)
    sig = np.full((len(sets), m), np.iinfo(np.int64).max, np.int64)
    flat = sig.reshape(-1)
    x = np.concatenate([*sets, np.zeros(0, np.uint64)])
    row = np.repeat(np.arange(len(sets)), size)
    swaps: list[np.ndarray] = []
    for rank in range(m):
        if not len(x):
            break
        r = mixed(x + np.uint64((rank + 1) * int(_C) & 0xFFFFFFFFFFFFFFFF))
        swap = rank + ((r >> np.uint64(32)) % np.uint64(m - rank)).astype(np.int64)
        place = swap
        for t in range(rank - 1, -1, -1):  # where the value that now stands there came from
            place = np.where(place == swaps[t], t, place)
        np.minimum.at(flat, row * m + place, (rank << 32) + (r & np.uint64(0xFFFFFFFF)).astype(np.int64))
        swaps.append(swap)
        left = (sig == np.iinfo(np.int64).max).any(1)[row]
        if not left.all():
            x, row, swaps = x[left], row[left], [s[left] for s in swaps]
    return sig


@dataclass(frozen=True)
class Settings:
    """k: words a shingle. percent: least similarity. bands x rows: signature places. least: equal places of a likely pair. meets: others that a set of an open bucket
    would meet, on average, for which leaders are sought once more.
    block: sets a side of one exact block, about; tile: numbers of its sets, about, or one set. per_task: pairs of sets confirmed in one task.

    A pair of similarity 0.85 shares no band with a chance of (1 - 0.85 ** 5) ** 26, about 2e-7, and has 110 equal places of 130, give or take 4, so 86
    are six deviations below.
    """

    k: int = 3
    percent: int = 85
    bands: int = 26
    rows: int = 5
    least: int = 86
    meets: int = 64
    block: int = 512
    per_task: int = 5_000
    tile: int = 4_000_000


#: Of all near-dedup but op1_minhash, whose contract Settings() holds. A pair of similarity 0.8 shares no band with a chance of (1 - 0.8 ** 5) ** 26,
#: about 3e-5, and has 104 equal places, give or take 4.6.
FIVE_WORDS = Settings(k=5, percent=80, least=77)


def _fingerprint(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def signatures(docs: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """(id, n, fp, sig) of each row: set size, the set's fingerprint, and 16 bits of each place of its signature (both null if empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, part in slices(b, 1, 1_000_000):
                sets = shingle_sets(part, s.k)
                sig = (mixed(super_minhash(sets, s.bands * s.rows).view(np.uint64)) >> np.uint64(48)).astype("<u2")
                some = [len(x) > 0 for x in sets]
                out = [
                    pa.array([len(x) for x in sets], pa.int64()), pa.array([_fingerprint(x) if y else None for x, y in zip(sets, some, strict=True)], pa.binary()),
                    pa.array([x.tobytes() if y else None for x, y in zip(sig, some, strict=True)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(part)), *out], ["id", "n", "fp", "sig"])

    kind = dict(docs.dtypes)[id_col]
    return mapped(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")), run, f"id {kind}, n long, fp binary, sig binary")


def _keys(s: Settings) -> list[Column]:
    """A hash of each band of a signature, apart from those of other bands."""
    width = 2 * s.rows
    return [F.xxhash64(F.substring("sig", j * width + 1, width), F.lit(j)) for j in range(s.bands)]


def _sets(docs: DataFrame, wanted: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """(fp, body) of the sets in wanted (one, fp): the texts of ids `one` are shingled again; body is the set as 64-bit numbers. Ids grow with the corpus, so they
    are merged at every size, never broadcast at some."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(wanted.select(F.col("one").alias("id")).distinct().hint("merge"), "id").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, part in slices(b, 0, 1_000_000):
                sets = [x for x in shingle_sets(part, s.k) if len(x)]
                made = [[_fingerprint(x) for x in sets], [x.tobytes() for x in sets]]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in made], ["fp", "body"])

    # ids may repeat with other texts, so sets are asked for by fingerprint too
    return mapped(texts, run, "fp binary, body binary").join(wanted.select("fp"), "fp").dropDuplicates(["fp"])


def _numbers(column: pa.Array, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in column]


def _likely(pairs: DataFrame, wanted: DataFrame, s: Settings) -> DataFrame:
    """Pairs of node numbers (v, u) as (a, b) of fingerprints where sizes allow a link and signatures make it likely."""
    side = lambda end, name: wanted.select(F.col("v").alias(end), F.col("fp").alias(name), F.col("n").alias(f"n_{name}"), F.col("sig").alias(f"sig_{name}"))
    sized = pairs.select("v", "u").join(side("v", "a"), "v").join(side("u", "b"), "u").where(100 * F.least("n_a", "n_b") >= s.percent * F.greatest("n_a", "n_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [int((x == y).sum()) >= s.least for x, y in zip(_numbers(batch.column("sig_a"), "<u2"), _numbers(batch.column("sig_b"), "<u2"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return mapped(sized.select("a", "b", "sig_a", "sig_b"), run, "a binary, b binary")


def _verified(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """(a, b, linked) of candidate pairs (a, b): similarity of full sets. Each row holds two sets, so a hub's rows need not meet in a task."""
    asked = pairs.select("a", "b")
    left = asked.join(sets.select(F.col("fp").alias("a"), F.col("body").alias("x")), "a")
    right = asked.join(sets.select(F.col("fp").alias("b"), F.col("body").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for p, q in zip(_numbers(batch.column("x"), "<u8"), _numbers(batch.column("y"), "<u8"), strict=True):
                both = np.sort(np.concatenate([p, q]), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                linked.append(100 * shared >= s.percent * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return mapped(left.join(right, ["a", "b"]).select("a", "b", "x", "y"), run, "a binary, b binary, linked boolean")


def _fixed(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """The rows of a binary column whose values all have one length."""
    return np.frombuffer(b"".join(x.as_buffer() for x in column), kind).reshape(-1, width)


def _by_cell(rows: DataFrame, cell: list[str], handle: Callable[[pa.RecordBatch, int, int], list[tuple[bytes, bytes]]]) -> DataFrame:
    """Pairs (a, b) that `handle` finds in each cell, given rows in order of cell and side and the cell's bounds. A task holds one cell and one batch."""

    def found(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.concat_batches(rows)
        of = np.stack([whole.column(c).to_numpy() for c in cell])
        cut = np.flatnonzero((of[:, 1:] != of[:, :-1]).any(0)) + 1
        pairs = [p for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), whole.num_rows], strict=True) for p in handle(whole, lo, hi)]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in range(2)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the last cell, which may go on
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            of = np.stack([b.column(c).to_numpy() for c in cell])
            cut = np.flatnonzero((of[:, 1:] != of[:, :-1]).any(0)) + 1
            start = int(cut[-1]) if len(cut) else 0
            if held and (start or (of[:, 0] != last).any()):
                yield found([*held, b.slice(0, start)])
                held = []
            elif start:
                yield found([b.slice(0, start)])
            held.append(b.slice(start))
            last = of[:, -1]
        if held:
            yield found(held)

    return mapped(rows.repartition(*cell).sortWithinPartitions(*cell, "side"), run, "a binary, b binary")


class _Union:
    """Union-find over small numbers; `joined` keeps the pairs that joined two classes."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.joined: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        p, q = self.root(x), self.root(y)
        if p != q:
            self.up[max(p, q)] = min(p, q)
            self.joined.append((x, y))


def _spans(cells: DataFrame, s: Settings) -> DataFrame:
    """Pairs that span all likely pairs of what leaders have not settled: in a cell (key, i, j), each outsider (side 1) meets each member (side 0) of another class.

    A pair counts in the first of its common bands only.
    """

    def handle(rows: pa.RecordBatch, lo: int, hi: int) -> list[tuple[bytes, bytes]]:
        rows = rows.slice(lo, hi - lo)
        side, n = rows.column("side").to_numpy(), rows.column("n").to_numpy()
        mid, size = int(np.searchsorted(side, 1)), len(side)
        if mid in (0, size):
            return []
        sig, comp, band = _fixed(rows.column("sig"), "<u2", s.bands * s.rows), rows.column("comp").to_numpy(), rows.column("band")[0].as_py()
        union = _Union(size)
        step = max(1, 2_000_000 // (mid * sig.shape[1]))
        for at in range(mid, size, step):
            end = min(size, at + step)
            a, b = n[at:end, None], n[None, :mid]
            x, y = np.nonzero((comp[at:end, None] != comp[None, :mid]) & (100 * np.minimum(a, b) >= s.percent * np.maximum(a, b)))
            equal = sig[at + x] == sig[y]
            near = np.flatnonzero(equal.sum(1) >= s.least)
            near = near[equal[near].reshape(len(near), s.bands, s.rows).all(2).argmax(1) == band]
            for i, j in zip((at + x[near]).tolist(), y[near].tolist(), strict=True):
                union.join(i, j)
        fp = rows.column("fp")
        return [(fp[i].as_py(), fp[j].as_py()) for i, j in union.joined]

    return _by_cell(cells.select("key", "i", "j", "side", "band", "n", "fp", "comp", "sig"), ["key", "i", "j"], handle)


def _links_of(tiles: DataFrame, s: Settings) -> DataFrame:
    """Links that join the classes of a tile (kin, i, j) as far as any can: likely pairs of sets of its two sides (i < j), or of all its sets (i = j), are confirmed on full
    sets unless their classes are joined already."""

    def handle(rows: pa.RecordBatch, lo: int, hi: int) -> list[tuple[bytes, bytes]]:
        rows = rows.slice(lo, hi - lo)
        side, n = rows.column("side").to_numpy(), rows.column("n").to_numpy()
        sig, sets = _fixed(rows.column("sig"), "<u2", s.bands * s.rows), _numbers(rows.column("body"), "<u8")
        classes = np.unique(rows.column("comp").to_numpy(), return_inverse=True)[1]
        union, found = _Union(int(classes.max()) + 1), []
        kin = classes.tolist()
        two_sides = side[0] != side[-1]
        for i in range(len(side)):
            others = np.arange(i) if not two_sides else np.flatnonzero(side[:i] != side[i])
            others = others[(classes[others] != classes[i]) & (100 * np.minimum(n[others], n[i]) >= s.percent * np.maximum(n[others], n[i]))]
            same = (sig[others] == sig[i]).sum(1)
            for j in others[np.argsort(-same, kind="stable")][: int((same >= s.least).sum())].tolist():
                if union.root(kin[i]) != union.root(kin[j]):
                    both = np.sort(np.concatenate([sets[i], sets[j]]), kind="stable")
                    shared = int((both[1:] == both[:-1]).sum())
                    if 100 * shared >= s.percent * (len(both) - shared):
                        union.join(kin[i], kin[j])
                        found.append((rows.column("fp")[i].as_py(), rows.column("fp")[j].as_py()))
        return found

    return _by_cell(tiles.select("kin", "i", "j", "side", "n", "fp", "comp", "sig", "body"), ["kin", "i", "j"], handle)


def _rest_links(open_: DataFrame, wanted: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Links (a, b) that join what is still open, from rows (key, fp, n, sig, comp, main, size, most) of buckets of several classes. A table of `written`.

    Signatures alone meet in blocks a bucket; what likely pairs span is a kin. The sets of a kin then meet once, in tiles, however many bands they share.
    """
    chunk = lambda n: F.ceil(n / F.lit(s.block)).cast("int")
    others = F.col("size") - F.col("most")
    part = lambda n, name: F.pmod(F.xxhash64("fp", F.lit(name)), n).cast("int")
    base = ["key", (F.array_position(F.array(*_keys(s)), F.col("key")) - 1).alias("band"), "fp", "n", "comp", "sig"]
    members = open_.select(*base, F.lit(0).alias("side"), part(chunk(F.col("size")), "m").alias("i"), F.explode(F.sequence(F.lit(0), chunk(others) - 1)).alias("j"))
    outsiders = open_.where("comp != main").select(*base, F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), chunk(F.col("size")) - 1)).alias("i"), part(chunk(others), "o").alias("j"))
    spans = written(_spans(members.unionByName(outsiders), s), "minhash-spans")
    kins = components(spans, rows=spans.count())
    nodes = kins.select(F.col("node").alias("fp"), F.xxhash64("comp").alias("kin")).join(wanted.select("fp", "n", "sig"), "fp").join(open_.select("fp", "comp").distinct(), "fp").join(sets, "fp")
    sizes = kins.join(wanted.select(F.col("fp").alias("node"), "n"), "node").groupBy(F.xxhash64("comp").alias("kin")).agg(
        F.greatest(chunk(F.count("*")), F.ceil(F.sum("n") / F.lit(s.tile)).cast("int")).alias("parts")
    )
    dealt = nodes.join(sizes, "kin").withColumn("own", part(F.col("parts"), "t")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).withColumn("side", (F.col("own") > F.col("other")).cast("int"))
    found = written(_links_of(tiles, s), "minhash-rest")
    discard(spans, kins)
    return found


def _classed(wanted: DataFrame, comps: DataFrame, s: Settings) -> DataFrame:
    """(key, v, comp) of each band of each wanted set: the class of a set, as a number; one without a link is its own. Classes join sets, not their many bands; bands
    that no other set has are in no bucket of several classes."""
    classes = comps.select(F.xxhash64("node").alias("v"), F.xxhash64("comp").alias("comp"))
    return wanted.select("v", "sig").join(classes, "v", "left").select(F.explode(F.array(*_keys(s))).alias("key"), "v", F.coalesce("comp", "v").alias("comp"))


def _mains(known: DataFrame, turn: int) -> DataFrame:
    """(key, main, u, size, most) of buckets of several classes: their largest class, a member of it by the hash of this turn, and how many they and it are."""
    by_class = known.groupBy("key", "comp").agg(F.count("*").alias("k"), F.min(F.struct(F.xxhash64("v", F.lit(turn)).alias("h"), F.col("v").alias("v"))).alias("lead"))
    out = by_class.groupBy("key").agg(F.max(F.struct("k", "comp", "lead.v")).alias("top"), F.sum("k").alias("size"), F.max("k").alias("most")).where("most < size")
    return out.select("key", F.col("top.comp").alias("main"), F.col("top.v").alias("u"), "size", "most")


def near_groups(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, component) for each row: set size, and the smallest id that links reach.

    Two rows link if their shingle sets are `s.percent` percent alike or more, found through common bands and confirmed on full sets; so do rows of one id,
    whatever their texts. Empty sets (null, empty and blank texts) link with nothing else; rows with a null id link with nothing and have a null component.
    Equal sets are one node of the graph, so copies cost nothing. Long texts are shingled whole. Ties go to the smaller hash; the result hangs on no order. An
    empty table gives no rows. Columns other than the two named are not read.

    A bucket of many sets is not expanded into pairs. In each round, its sets outside its largest class meet one leader of that class; each set tries the leader
    with which it shares most buckets. Rounds go on while they join a tenth of those tried and much is left. What is then still outside meets all others, in blocks
    of bounded size that hold signatures alone; full sets travel where likely pairs are only.
    """
    rows = written(signatures(docs, s, id_col, text_col), "minhash-rows")
    nodes = rows.where("fp is not null and id is not null").groupBy("fp").agg(F.min("id").alias("one"), F.min("n").alias("n"), F.min("sig").alias("sig")).withColumn("v", F.xxhash64("fp"))
    nodes = written(nodes, "minhash-nodes")
    each = nodes.select("v", F.explode(F.array(*_keys(s))).alias("key"))
    often = each.groupBy("key").agg(F.count("*").alias("size"), F.max("v").alias("u")).where("size > 1").select("key", "u")
    buckets = written(each.join(often, "key"), "minhash-buckets")
    wanted = written(nodes.join(buckets.select("v").distinct(), "v"), "minhash-wanted")
    sets = written(_sets(docs, wanted, s, id_col, text_col), "minhash-sets")

    # rows of one id with several sets
    twice = rows.where("id is not null").groupBy("id").agg(F.count("*").alias("k"), F.min("fp").alias("a"), F.max("fp").alias("z")).where("k > 1")
    twice = written(twice.select("id", "a", "z"), "minhash-twice")
    n_sets = wanted.count()
    of_one = rows.join(twice.where("a != z"), "id").where("fp != a").select("a", F.col("fp").alias("b"))
    links = written(of_one.distinct(), "minhash-links", rows=2 * twice.count())
    asked, turn, spent = buckets.where("v != u"), 0, []
    while True:
        # a set stands in s.bands buckets at most, so its leaders are few
        pairs = asked.groupBy("v").agg(F.mode("u", True).alias("u"))
        likely = written(_likely(pairs, wanted, s), "minhash-likely", n_sets, s.per_task)
        n_likely = likely.count()
        found = written(_verified(likely, sets, s).where("linked").select("a", "b"), "minhash-found", n_likely, s.per_task)
        links, old = written(links.unionByName(found), "minhash-links", links.count() + n_likely), links
        comps, turn = components(links, rows=links.count()), turn + 1
        known = written(_classed(wanted, comps, s), "minhash-known", s.bands * n_sets)
        mains = written(_mains(known, turn), "minhash-mains", s.bands * n_sets)
        enough = 10 * found.count() < n_likely
        discard(old, likely, found, comps, *spent)
        rows_left, meets = mains.agg(F.sum("size"), F.sum(F.col("size") * (F.col("size") - F.col("most")))).first()
        spent = [known, mains]
        if not rows_left or enough or meets <= s.meets * rows_left:
            break
        asked = known.join(mains, "key").where("comp != main")

    # what no leader has joined to the rest of its bucket meets all of it
    open_ = known.join(mains.drop("u"), "key").join(wanted.drop("one"), "v")
    rest = _rest_links(open_, wanted, sets, s)
    final = components(links.unionByName(rest), rows=links.count() + rest.count())
    discard(buckets, sets, wanted, links, rest, *spent)

    joined = final.select(F.col("node").alias("fp"), "comp").join(nodes.select("fp", "one"), "fp")
    joined = joined.join(joined.groupBy("comp").agg(F.min("one").alias("least")), "comp").select("fp", "least")
    labelled = nodes.select("fp", "one").join(joined, "fp", "left").select("fp", F.coalesce("least", "one").alias("component"))
    # rows without words share what other rows of their id reach
    by_id = twice.where("a is not null").select("id", F.col("a").alias("fp")).join(labelled, "fp").select("id", F.col("component").alias("other"))
    return rows.join(labelled, "fp", "left").join(by_id, "id", "left").select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("component", "other", "id")).alias("component"))


def drop_near_copies(docs: DataFrame, s: Settings = FIVE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that link to a smaller id; rows with a null id or without words stay, and so does each row of a kept id. Other columns pass through."""
    name = fresh("kd_gone", docs)
    gone = near_groups(docs, s, id_col, text_col).where("component < id").select(F.col("id").alias(name)).distinct()
    return docs.join(gone, docs[id_col] == gone[name], "left_anti")


def op1_minhash(docs: DataFrame) -> DataFrame:
    """The contract's digest of `near_groups`, which states nulls, empty and long texts, ties, repeated ids, empty tables and other columns. A null id is its own and kept."""
    return near_groups(docs).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT row, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i+2], ' ')) END) AS sh FROM w),
n AS (SELECT row, count(*) AS n FROM s GROUP BY row),
p AS (SELECT a.row AS a, b.row AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.row < b.row GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.row JOIN n y ON b = y.row WHERE 100 * k >= 85 * (x.n + y.n - k) UNION ALL SELECT a.row, b.row FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.row < b.row),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT row AS node, row AS spot FROM w UNION SELECT r.node, e.b FROM r JOIN e ON r.spot = e.a),
c AS (SELECT node, min(w.doc_id) AS c FROM r JOIN w ON w.row = r.spot GROUP BY node)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.c AS component_id, w.doc_id = c.c AS kept FROM w LEFT JOIN n USING (row) JOIN c ON c.node = w.row
"""
