"""Products of large sides, and joins on keys with very many rows, dealt into blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block, about: a pair of blocks makes at most some 65,000 rows, in one task.
BLOCK = 256

#: Rows of one key that go to one task, about, in `lookup`.
HEAVY = 100_000


def product(left: DataFrame, right: DataFrame, on: list[str], block: int = BLOCK) -> DataFrame:
    """All pairs of rows that agree in `on`, with the columns of both (which share no others).

    The product is what is asked for, so its rows can't be fewer; but a value of `on` with many rows is not one key. Each side's rows of it are dealt by hash into blocks of about `block` rows,
    and pairs of blocks are the keys of an equi join: a row goes out once for each block of the other side, a `block`-th of what it makes there.
    """
    rest = lambda df: [c for c in df.columns if c not in on]
    sizes = lambda df, name: df.groupBy(on).agg(F.ceil(F.count("*") / block).alias(name))
    both = sizes(left, "kd_m").join(sizes(right, "kd_n"), on)

    def dealt(df: DataFrame, own: str, of: str, other: str, count: str) -> DataFrame:
        place = F.pmod(F.xxhash64(*rest(df)), F.col(of)).cast("int").alias(own)
        return df.join(both, on).select(*on, *rest(df), place, _upto(F.col(count)).alias(other))

    return dealt(left, "kd_b", "kd_m", "kd_c", "kd_n").join(dealt(right, "kd_c", "kd_n", "kd_b", "kd_m"), [*on, "kd_b", "kd_c"]).select(*on, *rest(left), *rest(right))


def _upto(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n.cast("int") - 1))


def lookup(many: DataFrame, few: DataFrame, on: list[str], how: str = "inner", counted: DataFrame | None = None, heavy: int | None = None) -> DataFrame:
    """The equi join of `many`, in which a key may have very many rows, with `few`, which has some for each (`how`: inner or left).

    Rows of a key of more than `heavy` rows (HEAVY unless given) are dealt by hash into parts of about that many, and the key's rows of `few` go out once for each part; all other rows stay as they are. Such keys are
    no more than a `heavy`-th of the rows, so the table of them is small and is broadcast. counted: a table with the keys of `many`, if that one is costly to make twice.
    """
    heavy = heavy or HEAVY
    parts = (many if counted is None else counted).groupBy(on).agg(F.ceil(F.count("*") / heavy).cast("int").alias("kd_parts")).where("kd_parts > 1")
    count = F.coalesce("kd_parts", F.lit(1))
    dealt = many.join(F.broadcast(parts), on, "left").select(*many.columns, F.pmod(F.xxhash64(*many.columns), count).cast("int").alias("kd_part"))
    spread = few.join(F.broadcast(parts), on, "left").select(*few.columns, _upto(count).alias("kd_part"))
    return dealt.join(spread.hint("merge"), [*on, "kd_part"], how).drop("kd_part")  # sizes are estimated from packed files; a table that grows is no broadcast
