"""Line dedup: overlapping windows of three lines, hashed; later occurrences of a repeated window are removed everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import fresh, without

#: A line counts in windows if it has a word, a run of characters other than these.
HAS_WORD = r"[^\x20\x09-\x0D]"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def repeated_windows(docs: DataFrame, window: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, covered): for each document the line numbers, from 0, that later occurrences of repeated windows cover.

    One shuffle sums windows (a row for each distinct window and task, so a frequent window is no hot key), one joins the
    repeated ones back; there the window's own side has a row a key, and AQE may split the other side.
    """
    seen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).where(F.col("body").isNotNull())
    with_word = F.filter(F.transform(_lines(F.col("body")), lambda x, i: F.struct(i.alias("at"), x.alias("line"))), lambda x: x["line"].rlike(HAS_WORD))
    rows = seen.select("id", F.xxhash64("body").alias("mark"), with_word.alias("lines")).where(F.size("lines") >= window)
    each = rows.select("id", "mark", F.explode(F.transform(F.sequence(F.lit(1), F.size("lines") - window + 1), lambda k: F.slice("lines", k, window))).alias("w")).select(
        F.struct("id", "mark", F.col("w")[0]["at"].alias("at")).alias("place"), F.col("w.at").alias("ats"), F.unhex(F.md5(F.array_join(F.col("w.line"), "\n"))).alias("hash")
    )
    # equal rows (same id, same text) are one document, so places are counted apart from their repetition
    first = each.groupBy("hash").agg(F.min("place").alias("lo"), F.max("place").alias("hi")).where("lo < hi").select("hash", "lo")
    later = each.join(first, "hash").where(F.col("place") != F.col("lo"))
    spread = later.select("place.id", "place.mark", F.explode("ats").alias("at"))
    return spread.groupBy("id", "mark").agg(F.collect_set("at").alias("covered"))


def dedup_lines(docs: DataFrame, window: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with `text_col` rewritten, and two columns more: kd_lines, kd_removed (line counts).

    A window is `window` consecutive lines that have a word (lines without one are skipped and always stay). The first occurrence, by
    id (null first), then the text's hash, then line, stays; the lines of all others are merged and removed, even those that
    overlap the first one. Texts of fewer lines have no window and stay as they are. A null text stays null with no lines;
    an empty text is one line. Rows that repeat a document (same id, same text) count once and get the same result.
    An empty table gives no rows. Columns of docs pass through, but those named kd_lines and kd_removed are replaced.
    """
    docs = without(docs, "kd_lines long, kd_removed long")
    key, of, mark, gone = (fresh(n, docs) for n in ("kd_key", "kd_id", "kd_mark", "kd_covered"))
    covered = repeated_windows(docs, window, id_col, text_col).select(F.col("id").alias(of), F.col("mark").alias(mark), F.col("covered").alias(gone))
    marked = docs.withColumn(key, F.xxhash64(text_col))
    both = marked.join(covered, F.col(id_col).eqNullSafe(F.col(of)) & (F.col(key) == F.col(mark)), "left")
    # the split text is bound once, as the element of a list; else each kept line would split it again
    kept = lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), gone), lambda i: F.get(ls, i)), "\n")
    stays = F.get(F.transform(F.array(_lines(F.col(text_col))), kept), F.lit(0))
    n = F.when(F.col(text_col).isNotNull(), F.size(_lines(F.col(text_col)))).otherwise(0)
    return both.select(
        *(F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(stays).alias(text_col) if c == text_col else F.col(c) for c in docs.columns),
        n.cast("long").alias("kd_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("kd_removed"),
    )


def op7_line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, line counts and text of `dedup_lines`, which states all odd cases."""
    return dedup_lines(docs).select("doc_id", F.col("kd_lines").alias("n_lines"), F.col("kd_removed").alias("n_removed"), "text")


OP7_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
nb AS (SELECT doc_id, i, line FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
w AS (SELECT doc_id, i, lead(i, 1) OVER d AS i1, lead(i, 2) OVER d AS i2, line || chr(10) || lead(line, 1) OVER d || chr(10) || lead(line, 2) OVER d AS body FROM nb WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, i) AS r FROM w WHERE body IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, unnest([i, i1, i2]) AS i FROM ranked WHERE r > 1)
SELECT l.doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(gone.i) AS BIGINT) AS n_removed, coalesce(string_agg(CASE WHEN gone.i IS NULL THEN l.line END, chr(10) ORDER BY l.i), '') AS text
FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i GROUP BY l.doc_id
"""
