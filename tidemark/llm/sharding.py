"""Shards along a Hilbert curve over document metadata, in DataFrame functions only.

Source, language and size are quantised to 4 bits each; the curve index of the cell
orders the rows, so that each shard (a run of the order) has few cells and files prune
on several dimensions. Ranks come from counts of cells, with each cell dealt into
parts, so no sort of all rows and no hot cell in one task is needed. Shards differ by
one row at most (law ``rows``). Rows of equal text take the coordinates of their smallest doc_id and stand side by side
in the order: in one shard or, where the law cuts their run, in neighbouring ones. A text with more than 1 / HOT_SHARE of
all rows is a run of parts of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

BITS = 4
#: A cell may hold most rows; it is ranked in so many parts, or one for each PART_ROWS of all rows.
CELL_PARTS, PART_ROWS = 128, 500_000
#: Texts with more than 1 / HOT_SHARE of all rows are fewer than HOT_SHARE; their list is broadcast.
HOT_SHARE = 1000
#: Rows of a shard that one task writes.
FILE_ROWS = 1_000_000


def hilbert_index(dims: list[Column], bits: int = BITS) -> Column:
    """Index along the Hilbert curve of integer coordinates below ``2**bits``.

    Skilling's transform: undo the rotations of each level from the top, Gray-encode,
    interleave the bits. Neighbouring indexes differ by one in one coordinate.
    """
    n = len(dims)
    steps = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def turn(x: Column, s: Column) -> Column:
        here, first, low = F.get(x, s["i"]), F.get(x, F.lit(0)), s["q"] - 1
        swap = first.bitwiseXOR(here).bitwiseAND(low)
        high = here.bitwiseAND(s["q"]) != 0
        lead = F.when(high, first.bitwiseXOR(low)).otherwise(first.bitwiseXOR(swap))
        return F.array(lead, *[F.when((s["i"] == k) & ~high, F.get(x, F.lit(k)).bitwiseXOR(swap)).otherwise(F.get(x, F.lit(k))) for k in range(1, n)])

    def gray(x: Column) -> Column:
        out = [F.get(x, F.lit(0))]
        for k in range(1, n):
            out.append(F.get(x, F.lit(k)).bitwiseXOR(out[-1]))
        flip = F.lit(0)
        for b in range(bits - 1, 0, -1):
            flip = flip.bitwiseXOR(F.when(out[-1].bitwiseAND(F.lit(1 << b)) != 0, (1 << b) - 1).otherwise(0))
        return F.array(*[v.bitwiseXOR(flip) for v in out])

    def woven(x: Column) -> Column:
        total = F.lit(0)
        for b in range(bits - 1, -1, -1):
            for k in range(n):
                total = total * 2 + F.shiftright(F.get(x, F.lit(k)), b).bitwiseAND(F.lit(1))
        return total

    def last(x: Column, f) -> Column:  # names x once, so that the expression stays small
        return F.get(F.transform(F.array(x), f), F.lit(0))

    return last(last(F.aggregate(steps, F.array(*[d.cast("int") for d in dims]), turn), gray), woven)


def hilbert_shards(docs: DataFrame, shards: int = 24) -> DataFrame:
    """``doc_id, size, text_crc32, cell, shard, slot`` for each row of ``docs`` (``doc_id, text, lang, source``).

    ``size`` is the UTF-8 bytes of the text (null: none) plus 8. Rows of one cell stand
    in order of part, checksum, size and doc_id; repeated rows get a place each, a null text counts as empty. An
    empty table gives no rows; with fewer rows than shards some shards are empty.
    """
    level = (1 << BITS) - 1
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    name = lambda c: F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(1 << BITS)).cast("int")
    rows = saved(
        docs.select(
            "doc_id", size.alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
            name("lang").alias("x"), name("source").alias("y"), F.least(F.lit(level), F.greatest(F.lit(0), F.floor(F.log2(size)) - 3)).cast("int").alias("z"),
        )
    )
    total = rows.count()
    parts = max(CELL_PARTS, total // PART_ROWS)
    rows = _together(rows, total, parts).withColumn("cell", (F.col("x") * (1 << 2 * BITS) + F.col("y") * (1 << BITS) + F.col("z")).cast("int"))
    part = ["part", "run", "sub"]
    counts = rows.groupBy("cell", *part).agg(F.count("*").alias("n"), F.first("x").alias("x"), F.first("y").alias("y"), F.first("z").alias("z"))
    cells = counts.groupBy("cell").agg(F.sum("n").alias("n"), F.first("x").alias("x"), F.first("y").alias("y"), F.first("z").alias("z"))
    cells = cells.withColumn("curve", hilbert_index([F.col("x"), F.col("y"), F.col("z")]))  # 4,096 rows at most
    cells = cells.select("cell", "curve", F.sum("n").over(Window.partitionBy()).alias("total"), (F.sum("n").over(Window.orderBy("curve")) - F.col("n")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("cell").orderBy(*part)) - F.col("n")
    base = counts.select("cell", *part, inside.alias("inside")).join(cells, "cell").select("cell", *part, "curve", "total", (F.col("before") + F.col("inside")).alias("base"))
    order = F.row_number().over(Window.partitionBy("cell", *part).orderBy("text_crc32", "size", "doc_id"))
    ranked = rows.withColumn("k", order).join(base, ["cell", *part]).withColumn("rank", F.col("base") + F.col("k") - 1)
    shard = F.expr(f"rank * {shards} div total")
    return ranked.withColumn("shard", shard.cast("int")).select(
        "doc_id", "size", "text_crc32", F.col("curve").alias("cell"), "shard", (F.col("rank") - F.expr(f"(shard * total + {shards - 1}) div {shards}")).alias("slot")
    )


def _together(rows: DataFrame, total: int, parts: int) -> DataFrame:
    """``rows`` with equal texts (of one checksum and size) at the coordinates of their smallest doc_id, and ``part, run, sub``: texts
    are dealt into parts by checksum; a text with very many rows is a run of its own behind its part, dealt by doc_id."""
    text = ["text_crc32", "size"]
    groups = rows.groupBy(*text).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "x", "y")).alias("first")).where("n > 1")
    groups = saved(groups.select(*text, "n", F.col("first.x").alias("own_x"), F.col("first.y").alias("own_y")))
    hot = groups.where(F.col("n") * HOT_SHARE > total).select(*text, F.col("own_x").alias("hot_x"), F.col("own_y").alias("hot_y"))
    some = groups.where(F.col("n") * HOT_SHARE <= total).select(*text, F.lit(0).alias("salt"), "own_x", "own_y")
    # rows of the broadcast texts match nothing in the second join, and are spread there
    out = rows.join(F.broadcast(hot), text, "left").withColumn("salt", F.when(F.col("hot_x").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))).cast("int"))
    out = out.join(some, [*text, "salt"], "left")
    is_hot = F.col("hot_x").isNotNull()
    return out.select(
        "doc_id", *text, F.coalesce("hot_x", "own_x", "x").alias("x"), F.coalesce("hot_y", "own_y", "y").alias("y"), "z", F.pmod(F.xxhash64(*text), F.lit(parts)).cast("int").alias("part"),
        F.struct(*[F.when(is_hot, F.col(c)).otherwise(-1).alias(c) for c in text]).alias("run"), F.when(is_hot, F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")).otherwise(0).alias("sub"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24) -> None:
    """Writes ``docs`` with ``shard`` and ``slot`` (columns of ``docs`` with these names are replaced), a folder for each shard.

    Rows that share a doc_id and text each get one of these rows' places. An empty table writes no rows.
    """
    copy = Window.partitionBy("doc_id", "text_crc32").orderBy(F.lit(0))
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    given = docs.select("doc_id", crc.alias("text_crc32"), F.struct(*[c for c in docs.columns if c not in ("shard", "slot")]).alias("row"))
    placed = hilbert_shards(docs, shards).select("doc_id", "text_crc32", "shard", "slot")
    a, b = given.withColumn("copy", F.row_number().over(copy)).alias("a"), placed.withColumn("copy", F.row_number().over(copy)).alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_crc32") == F.col("b.text_crc32")) & (F.col("a.copy") == F.col("b.copy"))
    out = a.join(b, same).select("row.*", "shard", "slot")
    # a task writes into one folder or few
    out = out.repartition("shard", F.floor(F.col("slot") / FILE_ROWS)).sortWithinPartitions("shard", "slot")
    out.write.partitionBy("shard").mode("overwrite").parquet(path)
