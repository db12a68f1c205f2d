"""The format's stages as DataFrame operators, for analysis of short values and checks by SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockloom.functions.columns import chunk_expr

RUN = 259  # longest run of the first run coder: four bytes and up to 255 repeats


def positions(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, sym): the characters of a text column, from position 0."""
    return rows.where(f"length({text}) > 0").select(key, F.posexplode(F.split(F.col(text), "")).alias("pos", "sym"))


def byte_histogram(rows: DataFrame, column: str) -> DataFrame:
    """(byte, n): how often each byte value occurs in a column; counted in parts before the shuffle."""
    hexes = rows.select(F.explode(F.expr(f"regexp_extract_all(hex(cast({column} as binary)), '..', 0)")).alias("h"))
    return hexes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).select(F.conv("h", 16, 10).cast("int").alias("byte"), "n")


def exclusive_prefix(histogram: DataFrame) -> DataFrame:
    """Counts of all smaller bytes, for a counting sort; at most 256 rows meet in the window."""
    before = Window.orderBy("byte").rowsBetween(Window.unboundedPreceding, -1)
    return histogram.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint"))


def symbol_map(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, symbols, alphabet_size): distinct characters in order; the coder's alphabet has two more."""
    return rows.select(key, F.array_sort(F.array_distinct(F.split(F.col(text), ""))).alias("s")).select(key, F.array_join("s", "").alias("symbols"), (F.size("s") + 2).alias("alphabet_size"))


def runs(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start, sym, length): runs of equal characters, cut after RUN of them."""
    at = positions(rows, key, text)
    same = Window.partitionBy(key, "sym").orderBy("pos")
    island = at.withColumn("island", F.col("pos") - F.row_number().over(same))
    part = island.withColumn("part", F.floor((F.row_number().over(Window.partitionBy(key, "sym", "island").orderBy("pos")) - 1) / RUN))
    return part.groupBy(key, "sym", "island", "part").agg(F.min("pos").cast("bigint").alias("start"), F.count(F.lit(1)).alias("length")).select(key, "start", "sym", "length")


def rle1(run_rows: DataFrame, key: str) -> DataFrame:
    """(key, encoded): runs written as up to four characters and, from four on, '<repeats>'."""
    coded = F.when(F.col("length") >= 4, F.concat(F.expr("repeat(sym, 4)"), F.lit("<"), (F.col("length") - 4).cast("string"), F.lit(">"))).otherwise(F.expr("repeat(sym, cast(length as int))"))
    listed = F.expr("transform(array_sort(collect_list(struct(start, e))), x -> x.e)")
    return run_rows.withColumn("e", coded).groupBy(key).agg(F.array_join(listed, "").alias("encoded"))


def bwt(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, last_column, origin): characters before each sorted rotation. Equal rotations keep the order
    of their starts."""
    n = f"length({text})"
    spun = rows.where(f"{n} > 0").select(key, F.col(text).alias("t"), F.explode(F.expr(f"sequence(0, {n} - 1)")).alias("i"))
    rotated = spun.select(key, "i", F.expr("concat(substring(t, i + 1), substring(t, 1, i))").alias("r"))
    ranked = rotated.withColumn("row", F.row_number().over(Window.partitionBy(key).orderBy("r", "i")) - 1)
    last = F.expr("array_join(transform(array_sort(collect_list(struct(row, right(r, 1) as c))), x -> x.c), '')")
    return ranked.groupBy(key).agg(last.alias("last_column"), F.min(F.when(F.col("i") == 0, F.col("row"))).alias("origin"))


def inverse_bwt(coded: DataFrame, key: str) -> DataFrame:
    """(key, content) from (key, last_column, origin): sort the column, follow the successors."""
    at = coded.select(key, "origin", F.posexplode(F.split("last_column", "")).alias("pos", "c"))
    ranked = at.withColumn("row", F.row_number().over(Window.partitionBy(key).orderBy("c", "pos")))
    # row k of the sorted column holds a character and where it stands in the last column
    table = ranked.groupBy(key, "origin").agg(F.expr("array_sort(collect_list(struct(row, pos, c)))").alias("t"))
    walk = "aggregate(sequence(1, size(t)), named_struct('o', '', 'k', origin), (s, i) -> named_struct('o', s.o || t[s.k].c, 'k', t[s.k].pos), s -> s.o)"
    return table.select(key, F.expr(walk).alias("content"))


def mtf(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, sym, rank): place of each character in the list of recently used ones, which starts in
    character order. The rank is the number of distinct characters since its last use; at its
    first, those seen so far and the unseen smaller ones."""
    at = positions(rows, key, text)
    whole = at.withColumn("all", F.array_sort(F.collect_set("sym").over(Window.partitionBy(key))))
    prev = whole.withColumn("prev", F.lag("pos").over(Window.partitionBy(key, "sym").orderBy("pos")))
    seen = prev.withColumn("before", F.collect_list("sym").over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)))
    since = "size(array_distinct(slice(before, prev + 2, greatest(0, pos - prev - 1))))"
    first = "size(array_distinct(before)) + size(filter(array_except(all, before), x -> x < sym))"
    return seen.select(key, "pos", "sym", F.expr(f"if(prev is null, {first}, {since})").cast("bigint").alias("rank"))


def rle2(ranks: DataFrame, key: str) -> DataFrame:
    """(key, symbols): runs of rank 0 in bijective base two (A = 0, B = 1), other ranks plus one, then the
    end symbol E."""
    own = Window.partitionBy(key).orderBy("pos")
    grp = ranks.withColumn("g", F.sum(F.when(F.col("rank") == 0, 0).otherwise(1)).over(own))
    part = grp.groupBy(key, "g").agg(F.max(F.when(F.col("rank") > 0, F.col("rank"))).alias("r"), F.sum(F.when(F.col("rank") == 0, 1).otherwise(0)).alias("zeros"))
    digits = "translate(reverse(substring(conv(cast(zeros + 1 as string), 10, 2), 2)), '01', 'AB')"
    coded = F.expr(f"concat_ws(' ', if(r is null, null, cast(r + 1 as string)), if(zeros = 0, null, array_join(split({digits}, ''), ' ')))")
    listed = F.expr("array_join(transform(array_sort(collect_list(struct(g, s))), x -> x.s), ' ')")
    return part.withColumn("s", coded).groupBy(key).agg(F.concat(listed, F.lit(" E")).alias("symbols"))


def table_count(n: str) -> str:
    """Number of code tables for n symbols, as SQL."""
    return f"case when {n} >= 2400 then 6 when {n} >= 1200 then 5 when {n} >= 600 then 4 when {n} >= 200 then 3 else 2 end"


def canonical_codes(lengths: DataFrame, key: str) -> DataFrame:
    """(key, sym, len, code): codes by ascending length, then symbol. The code is the scaled Kraft sum of
    all earlier ones."""
    before = Window.partitionBy(key).orderBy("len", "sym").rowsBetween(Window.unboundedPreceding, -1)
    total = F.coalesce(F.sum(F.expr("shiftleft(1L, 20 - len)")).over(before), F.lit(0))
    return lengths.select(key, "sym", "len", total.alias("_t")).select(key, "sym", "len", F.expr("shiftright(_t, 20 - len)").alias("code"))


def kraft(lengths: DataFrame, key: str) -> DataFrame:
    """(key, kraft, complete, oversubscribed) of code lengths."""
    total = lengths.groupBy(key).agg(F.sum(F.expr("pow(2D, -len)")).alias("kraft"))
    return total.withColumn("complete", F.col("kraft") == 1).withColumn("oversubscribed", F.col("kraft") > 1)


def group_costs(symbols: DataFrame, key: str, tables: DataFrame, size: int = 50) -> DataFrame:
    """(key, grp, tab, cost): cheapest table of each group of 50 symbols, lowest number on a tie.
    `symbols` has key, pos, sym; `tables` (tab, sym, len) is at most six tables of 258 lengths."""
    cost = symbols.withColumn("grp", F.floor(F.col("pos") / size)).join(tables, "sym").groupBy(key, "grp", "tab").agg(F.sum("len").cast("bigint").alias("cost"))
    return cost.groupBy(key, "grp").agg(F.min(F.struct("cost", "tab")).alias("m")).select(key, "grp", "m.tab", "m.cost")


def chunked(rows: DataFrame, key: str, column: str, size: int) -> DataFrame:
    """(key, seq, chunk): a column in pieces of at most `size`; an empty value has none."""
    return rows.select(key, F.posexplode(F.expr(chunk_expr(column, size))).alias("seq", "chunk"))
