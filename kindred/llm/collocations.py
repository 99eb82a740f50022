"""Phrase collocations: n-grams as rows, counted for each language, scored against their parts, and thinned by longer ones that hold them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import byte_slices, mapped, written

#: Bytes of text whose n-grams are counted in one step, about, or one text.
STEP = 24_000_000
#: Partitions that n-grams are summed in, for each one that the session takes for other shuffles.
SPREAD = 2
#: Bits of a word's number in a step; a code of two numbers, the first of which may stand for a longer gram, fits into 63 bits.
BITS = 31
#: Rows that are spelled at once; a step's n-grams are numbers until then.
CHUNK = 65_536

_WORD, _SPACE, _BREAK = 0, 1, 2
#: What each byte is once A to Z are lower-cased, and the lower-cased byte.
_KIND, _LOWER = np.zeros(256, np.uint8), np.arange(256, dtype=np.uint8)
_KIND[[0x09, 0x20]] = _SPACE
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = _BREAK
_LOWER[ord("A") : ord("Z") + 1] += 32


@dataclass(frozen=True)
class Settings:
    """Phrases of 2 to `words` words found `least` times; one inside a longer one of `inside` percent of its count or more goes; the first `top` of each language are given."""

    words: int = 3
    least: int = 10
    inside: int = 50
    top: int = 2000


def _words_of(body: np.ndarray, starts: np.ndarray) -> tuple[pa.BinaryArray, np.ndarray]:
    """(words, piece) of UTF-8 texts in one row of bytes: the lower-cased words one after the other, and a number for the piece that each stands in; a text's start ends a piece."""
    kind = _KIND[body]
    inner = kind == _WORD
    edge = np.zeros(len(body) + 1, bool)
    edge[starts] = True
    begins = inner & edge[:-1]
    begins[1:] |= inner[1:] & ~inner[:-1]
    start = np.flatnonzero(begins).astype(np.int32)
    del begins
    stops = inner & edge[1:]
    stops[:-1] |= inner[:-1] & ~inner[1:]
    stops[-1:] |= inner[-1:]
    places = np.zeros(len(start) + 1, np.int32)
    np.cumsum(np.flatnonzero(stops) - start + 1, out=places[1:])
    del stops
    edge = edge[:-1]
    edge |= kind == _BREAK
    del kind
    piece = np.searchsorted(np.flatnonzero(edge).astype(np.int32), start, "right").astype(np.int32)
    letters = _LOWER[body[inner]]
    words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(places), pa.py_buffer(letters)])
    return words, piece


def _counted(texts: pa.StringArray, longest: int) -> Iterator[tuple[pa.StringArray, np.ndarray]]:
    """(grams, occurrences) of texts, CHUNK rows at most at a time: those of one word, of two words and so on, each by length, then in order of their words."""
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    words, piece = _words_of(np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends[:-1] - ends[0])
    coded = words.dictionary_encode()
    del words
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int32)
    rank[order.to_numpy()] = np.arange(len(order), dtype=np.int32)
    word, spelled = rank[coded.indices.to_numpy()], coded.dictionary.take(order).cast(pa.string())
    del coded
    size = pc.binary_length(spelled).to_numpy()
    codes: list[np.ndarray] = []  # of the distinct grams of 2 words, 3 words and so on: the number of the gram before the last word, and that word's

    def spelt(length: np.ndarray, n: np.ndarray) -> Iterator[tuple[pa.StringArray, np.ndarray]]:
        by_length = np.argsort(np.minimum(length, 0xFFFF).astype(np.uint16), kind="stable").astype(np.int32)
        for some in np.split(by_length, range(CHUNK, len(n), CHUNK)):
            parts, at = [], some
            for code in reversed(codes):
                parts.append(spelled.take(pa.array(code[at] & (1 << BITS) - 1)))
                at = code[at] >> BITS
            yield pc.binary_join_element_wise(spelled.take(pa.array(at)), *reversed(parts), " "), n[some]

    if len(word):
        yield from spelt(size, np.bincount(word, minlength=len(spelled)))
    number, length = word, size  # at each place, the number of the gram that starts there; bytes of the distinct grams
    for k in range(2, longest + 1):
        here = np.flatnonzero(piece[: len(piece) - k + 1] == piece[k - 1 :]).astype(np.int32)
        if not len(here):
            return
        code = number[here].astype(np.int64)
        code <<= BITS
        code |= word[here + np.int32(k - 1)]
        place = None
        if k < longest:
            place = np.argsort(code)
            code = code[place]
        else:
            number = None
            code.sort()
        new = np.ones(len(code), bool)
        np.not_equal(code[1:], code[:-1], out=new[1:])
        if place is not None:
            number = np.zeros(len(word), np.int32)
            number[here[place]] = np.cumsum(new, dtype=np.int32) - np.int32(1)
        del here, place
        first = np.flatnonzero(new)
        n = np.diff(first, append=len(code))
        code = code[first]
        del new, first
        codes.append(code)
        length = length[code >> BITS] + size[code & (1 << BITS) - 1] + 1
        yield from spelt(length, n)


def grams(docs: DataFrame, longest: int, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(gram, n) with a row for each n-gram of 1 to `longest` words in each step of texts: n occurrences of the words, one space between, in pieces of one language. That
    language and a line end, which is in no word, stand before the words, so one column says what is counted.

    Counts of a step are the map side of a sum, which needs less memory than a row for each occurrence; all n-grams of all texts are rows here. They come by length, then in order
    of their words: rows like the ones before them compress well on their way.
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("body")).where(F.octet_length("body") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            order = pc.sort_indices(b.column(0))
            tongues = b.column(0).take(order).dictionary_encode()
            at = 0
            for tongue, size in zip(tongues.dictionary, np.bincount(tongues.indices.to_numpy()).tolist(), strict=True):
                for _, texts in byte_slices(b.column(1).take(order[at : at + size]), STEP):
                    for gram, n in _counted(texts, longest):
                        yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(tongue, gram, "\n"), pa.array(n, pa.int64())], ["gram", "n"])
                at += size

    return mapped(rows, run, "gram string, n long")


def _part(start: int, size: Column | int) -> Column:
    """`size` words of the phrase, from word `start` (0: the first) on."""
    return F.array_join(F.slice("w", F.lit(start + 1), F.lit(size) if isinstance(size, int) else size), " ")


def collocations(docs: DataFrame, settings: Settings = Settings(), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: the best phrases of each language, whose words stand together more often than their parts' counts make likely.

    Texts are lower-cased (A to Z), cut into pieces at . , ; : ! ? and line ends, and those into words at spaces and tabs; all else, other white space too, belongs to words. a: occurrences of
    the phrase within pieces of the language, overlapping ones too; l and r: those of its two parts at the cut that scores least (of equal ones after the shortest first part);
    n: all words of the language; score: 1,000,000 a a / (l r), rounded down, in whole numbers (exact for counts below 10^16). Phrases inside a longer candidate that has
    `inside` percent of their count go, whether that one goes itself or not; it's enough to look one word further, as what is inside a yet longer one
    is inside one of those as often. Ranks go by score, a (both falling) and the phrase's bytes. A null language is `und`; null and empty texts have no words; repeated rows count as often
    as they stand; a table without words gives no rows; other columns of docs are not read.

    A sum over n-grams is all that moves much. Parts meet candidates by joins in which each part has one row, so a part that many phrases share is split by Spark where it is hot. The
    first `top` of a language are found in groups of phrases first, then in groups of those, so no task gets more than 64 times as many of one language. The result stands on two tables of `written`.
    """
    s = settings
    groups = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # steps have summed what repeats near by, so rows go to their partition as they are; there are more of them than an even share of the input
    rows = grams(docs, s.words, text_col, lang_col).repartition(SPREAD * groups, "gram")
    words = F.substring_index("gram", "\n", -1)
    lang = F.left("gram", F.length("gram") - F.length(words) - 1)
    one = ~words.contains(" ")
    counts = rows.groupBy("gram").agg(F.sum("n").alias("n")).where(one | (F.col("n") >= s.least))
    counts = written(counts.select(lang.alias("lang"), words.alias("gram"), "n"), "grams")
    total = counts.where(~F.contains("gram", F.lit(" "))).groupBy("lang").agg(F.sum("n").alias("words"))
    often = counts.where(F.col("n") >= s.least)
    cut = written(_best_cuts(often, s), "cuts")
    longer = cut.where("k > 2").select("lang", (F.col("k") - 1).alias("k"), "a", F.split("phrase", " ").alias("w"))
    held = reduce(DataFrame.unionByName, (longer.select("lang", "a", _part(i, F.col("k")).alias("phrase")) for i in (0, 1)))
    most = held.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = cut.join(most, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < s.inside * F.col("a"))).select("lang", "phrase", "a", "l", "r", "score")
    first = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    while groups > 1:
        by = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(groups))).orderBy(*first)
        kept = kept.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= s.top).drop("rank")
        groups //= 64
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*first))).where(F.col("rank") <= s.top)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", F.col("words").alias("n"), "score")


def _best_cuts(often: DataFrame, s: Settings) -> DataFrame:
    """(lang, k, phrase, a, l, r, score) of the candidates. often: all grams of `least` occurrences, parts of candidates among them."""
    split = often.select("lang", F.col("gram").alias("phrase"), F.col("n").alias("a"), F.split("gram", " ").alias("w"))
    phrases = split.where(F.size("w") > 1).withColumn("k", F.size("w"))
    parts = lambda name, n: often.select("lang", F.col("gram").alias(name), F.col("n").alias(n))
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("at"))
    cuts = cuts.select("lang", "k", "phrase", "a", "at", _part(0, F.col("at")).alias("head"), F.array_join(F.expr("slice(w, at + 1, k - at)"), " ").alias("tail"))
    both = cuts.join(parts("head", "l"), ["lang", "head"]).join(parts("tail", "r"), ["lang", "tail"])
    whole = lambda c: F.col(c).cast("decimal(16,0)")
    scored = both.select("lang", "k", "phrase", "a", "at", "l", "r", (whole("a") * whole("a") * F.lit(1_000_000).cast("decimal(7,0)")).alias("up"), (whole("l") * whole("r")).alias("down"))
    best = scored.groupBy("lang", "k", "phrase", "a").agg(F.min(F.struct(F.expr("up div down").alias("score"), "at", "l", "r")).alias("best"))
    return best.select("lang", "k", "phrase", "a", "best.l", "best.r", "best.score")


def op12_collocations(docs: DataFrame) -> DataFrame:
    """`collocations` of 2 to 3 words found 10 times: the first 2000 of each language."""
    return collocations(docs)


OP12_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, 1 AS k, unnest(w) AS g FROM w UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w
 UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w),
f AS MATERIALIZED (SELECT lang, k, g, CAST(count(*) AS BIGINT) AS n, string_split(g, ' ') AS w FROM g GROUP BY lang, k, g),
c AS (SELECT * FROM f WHERE k > 1 AND n >= 10),
cuts AS (SELECT c.lang, c.g, c.n AS a, 1 AS cut, c.w[1] AS head, array_to_string(c.w[2:], ' ') AS tail FROM c UNION ALL SELECT lang, g, n, 2, w[1] || ' ' || w[2], w[3] FROM c WHERE k = 3),
scored AS (SELECT cuts.*, h.n AS l, t.n AS r, CAST(1000000 * CAST(a AS HUGEINT) * a // (CAST(h.n AS HUGEINT) * t.n) AS BIGINT) AS score FROM cuts JOIN f h ON h.lang = cuts.lang AND h.g = cuts.head JOIN f t ON t.lang = cuts.lang AND t.g = cuts.tail),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
held AS (SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS g, n FROM c WHERE k = 3),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM held WHERE held.lang = b.lang AND held.g = b.g AND 100 * held.n >= 50 * b.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM kept),
total AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang)
SELECT lang, rank, g AS phrase, a, l, r, total.n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
