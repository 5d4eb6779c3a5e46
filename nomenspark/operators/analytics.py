"""Statistics of corpora and of runs of tools."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nomenspark.functions.descriptions import accession_parts


def batch(results: DataFrame) -> DataFrame:
    """total, ok, failed and rate of rows with a boolean ok."""
    n, ok = F.count("*"), F.count_if("ok")
    return results.agg(n.alias("total"), ok.alias("ok"), (n - ok).alias("failed"), F.round(F.try_divide(ok, n), 6).alias("rate"))


def stratified(rows: DataFrame, by: str, key: str, n: int, seed: int) -> DataFrame:
    """About n rows, each class in proportion, one row of each at least, in a seeded order.

    The class sizes are a small aggregate joined back; rows of a class are cut by rank within 256 hash ranges first, so that
    only the range in which a class's cut falls is ordered as a whole.
    """
    h = F.md5(F.concat(F.lit(str(seed)), F.col(key)))
    dealt = rows.withColumns({"_h": h, "_b": F.substring(h, 1, 2)})
    cells = dealt.groupBy(by, "_b").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(by)
    running = F.sum("_n").over(w.orderBy("_b"))
    total = rows.agg(F.count("*").alias("_total"))
    size = F.sum("_n").over(w)
    cells = cells.select(by, "_b", "_n", (running - F.col("_n")).alias("_before"), size.alias("_size")).crossJoin(F.broadcast(total))  # one row
    cells = cells.withColumn("_want", F.greatest(F.lit(1), F.ceil(n * F.col("_size") / F.col("_total")))).where("_before < _want").drop("_n", "_size", "_total")
    own = dealt.join(cells, [by, "_b"])
    rank = F.row_number().over(Window.partitionBy(by, "_b").orderBy("_h", key))
    return own.withColumn("_r", rank).where("_before + _r <= _want").select(*rows.columns)


def shards(rows: DataFrame, key: str, n: int) -> DataFrame:
    """rows with shard, 0 to n - 1, of nearly equal sizes and the same in every run: dealt in turn within 65,536 hash ranges,
    each starting where the one before ended. A task orders a few ranges, however many rows there are."""
    h = F.md5(F.col(key))
    dealt = rows.withColumns({"_h": h, "_b": F.conv(F.substring(h, 1, 4), 16, 10).cast("int")})
    cells = dealt.groupBy("_b").agg(F.count("*").alias("_n"))
    cells = cells.select("_b", (F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_b")) - F.col("_n")).alias("_before"))  # 65,536 rows at most
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))
    return dealt.withColumn("_r", rank).join(cells, "_b").withColumn("shard", ((F.col("_before") + F.col("_r") - 1) % n).cast("long")).select(*rows.columns, "shard")


def cancelling(members: DataFrame, by: list[str]) -> DataFrame:
    """by, s, e, how many deletions and duplications, and the first vid, of the bases that an allele both deletes and
    duplicates. members: by, vid, edit, s, e. Counts per class, so a crowded place emits no pairs."""
    own = members.where(F.col("edit").isin("del", "dup")).groupBy(*by, "s", "e")
    n = lambda x: F.count_if(F.col("edit") == x)
    return own.agg(n("del").alias("deletions"), n("dup").alias("duplications"), F.min("vid").alias("first")).where("deletions > 0 AND duplications > 0")


def agreement(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Per category, over inputs of either side: both ok, both failed, one side only, equal outputs among both ok, and their rate."""
    a = left.select(key, F.col("ok").alias("a"), F.col("output").alias("ao"), F.col("category").alias("ac"))
    b = right.select(key, F.col("ok").alias("b"), F.col("output").alias("bo"), F.col("category").alias("bc"))
    x, y = F.coalesce("a", F.lit(False)), F.coalesce("b", F.lit(False))
    both, same = F.count_if(x & y), F.count_if(x & y & (F.col("ao") == F.col("bo")))
    return a.join(b, key, "full").groupBy(F.coalesce("ac", "bc").alias("category")).agg(
        both.alias("both_ok"), F.count_if(~x & ~y).alias("both_failed"), F.count_if(x & ~y).alias("only_left"), F.count_if(y & ~x).alias("only_right"),
        same.alias("agree"), F.round(F.try_divide(same, both), 6).alias("rate"),
    )


def arbitrate(runs: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """runs with verdict (none where there is no override) and accepted."""
    joined = runs.join(overrides, key, "left").withColumn("verdict", F.coalesce("verdict", F.lit("none")))
    return joined.withColumn("accepted", F.col("ok") | (F.col("verdict") != "none"))


def inventory(rows: DataFrame, text: str) -> DataFrame:
    """Accessions that the texts name, by prefix."""
    found = rows.select(F.explode(F.regexp_extract_all(text, F.lit(r"([A-Z]{2}_\d+(?:\.\d+)?)"), F.lit(1))).alias("acc"))
    return found.groupBy(accession_parts(F.col("acc"))["prefix"].alias("prefix")).agg(F.count("*").alias("n"), F.count_distinct("acc").alias("accessions"))


def throughput(timings: DataFrame, by: list[str], baseline: dict) -> DataFrame:
    """by, total, ok, rate (a second) and speedup over the baseline's rate of runs (by, ok, seconds); null where the baseline
    did not run."""
    rates = timings.groupBy(*by).agg(F.count("*").alias("total"), F.count_if("ok").alias("ok"), F.try_divide(F.count("*"), F.sum("seconds")).alias("rate"))
    is_base = F.lit(True)
    for name, value in baseline.items():
        is_base = is_base & (F.col(name) == value)
    rest = [b for b in by if b not in baseline]
    base = rates.where(is_base).select(*[F.col(b).alias(f"_{b}") for b in rest], F.col("rate").alias("_rate"))  # one row a group
    on = F.lit(True)
    for b in rest:
        on = on & F.col(b).eqNullSafe(F.col(f"_{b}"))
    return rates.join(base, on, "left").select(*by, "total", "ok", F.round("rate", 6).alias("rate"), F.round(F.try_divide("rate", "_rate"), 6).alias("speedup"))


def missing(wanted: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """The distinct keys that are wanted and not held, and how often."""
    return wanted.join(held.select(key).distinct(), key, "left_anti").groupBy(key).agg(F.count("*").alias("n"))
