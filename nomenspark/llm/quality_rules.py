"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document; the ledger keeps the measurements and one bit per failed rule. A policy is a
versioned mask over those bits, so that another policy, or an ablation of one rule, is a bitwise operation on the
ledger and never touches a text again. No shuffle: each text is measured inside its own row.

Defined results: a null or empty text has no words and measures 0 everywhere; a very long text is measured whole;
repeated rows each get their row; an empty table gives an empty ledger; extra columns are passed by unless asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, text_of

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """Bit number, name and the SQL condition over the measurements under which a document fails."""

    bit: int
    name: str
    fails: str


#: Integer arithmetic only, so that every engine decides alike.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "n_symbols > n_words"),
    Rule(3, "repeated_lines", "n_words > 0 AND 100 * n_dup_lines > 60 * n_lines"),
    Rule(4, "word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 40 * n_words)"),
    Rule(5, "many_words", "n_words > 100000"),
)
BASE = 0b000011
#: Versioned policies: the rules whose failure rejects. Bits that no policy names are kept as measurements.
POLICIES = {"base-1": BASE, "2026-01": 0b011111, "2026-02": 0b111111}
DEFAULT_POLICY = "2026-01"


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row, also where body names it several times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column) -> Column:
    """Words in three-word windows that the array holds twice or more, the first occurrence included.

    The windows are sorted with their places, equal neighbours give the repeated places, and each place covers three
    words. The cost is n log n in the words of one document. Windows are told apart by their 64-bit hashes, within
    one document only.
    """
    n = F.size(words)
    windows = F.arrays_zip(F.slice(words, 1, n - 2), F.slice(words, 2, n - 2), F.slice(words, 3, n - 2))
    places = F.transform(windows, lambda x, i: F.struct(F.xxhash64(x["0"], x["1"], x["2"]).alias("h"), i.alias("i")))

    def repeated(s: Column) -> Column:
        h, i = s["h"], s["i"]
        before = F.concat(F.array(F.lit(None).cast("long")), F.slice(h, 1, F.size(h) - 1))
        after = F.concat(F.slice(h, 2, F.size(h)), F.array(F.lit(None).cast("long")))
        z = F.arrays_zip(i.alias("i"), h.alias("h"), before, after)
        return F.filter(z, lambda y: y["h"].eqNullSafe(y["2"]) | y["h"].eqNullSafe(y["3"]))["i"]

    def covered(p: Column) -> Column:
        return F.size(F.array_distinct(F.concat(p, F.transform(p, lambda j: j + 1), F.transform(p, lambda j: j + 2))))

    return F.when(n < 4, F.lit(0)).otherwise(let(let(F.sort_array(places), repeated), covered)).cast("long")


def ledger(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, the measurements n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, and failed_bits."""
    if len({r.bit for r in rules}) < len(rules) or not all(0 <= r.bit < 63 for r in rules):
        raise ValueError("each rule needs a bit of its own from 0 to 62")
    parts = df.select(
        *keep,
        F.regexp_extract_all(text_of(text), F.lit(f"({WORD})"), F.lit(1)).alias("_words"),
        F.filter(F.split(text_of(text), "\n", -1), lambda x: x.rlike(WORD)).alias("_lines"),
        F.regexp_count(text_of(text), F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
    )
    measured = parts.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_words")).alias("n_repeat_words"),
    )
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    # one row from an array: what is asked of the measurements later is asked of its result, and no filter measures anew
    numbers = [c for c in measured.columns if c not in keep]
    return measured.select(*keep, F.inline(F.array(F.struct(*numbers)))).withColumn("failed_bits", bits)


def apply_policy(df: DataFrame, policy: str = DEFAULT_POLICY, policies: dict[str, int] | None = None) -> DataFrame:
    """Adds kept: no rule that the policy names has failed."""
    mask = (policies or POLICIES)[policy]
    return df.withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(mask).cast("long")) == 0)


def ablations(df: DataFrame, policy: str = DEFAULT_POLICY, rules: tuple[Rule, ...] = RULES, policies: dict[str, int] | None = None) -> DataFrame:
    """One row per rule of the policy: documents that fail it, documents that it alone rejects (they would be kept
    without it), and the bits that ever fail together with it. The ledger is first reduced to its distinct bit sets,
    at most one row for each of them and task, so no rule or bit set makes a hot group."""
    mask = (policies or POLICIES)[policy]
    sets = df.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    named = F.array(*[F.struct(F.lit(r.bit).alias("bit"), F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("b")) for r in rules if mask >> r.bit & 1])
    each = sets.select("bits", "n", F.explode(named).alias("r"))
    hit = F.col("bits").bitwiseAND(F.col("r.b")) != 0
    return each.groupBy(F.col("r.bit").alias("bit"), F.col("r.rule").alias("rule")).agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("r.b"), F.col("n"))), F.lit(0)).alias("n_only"),
        F.coalesce(F.bit_or(F.when(hit, F.col("bits"))), F.lit(0)).alias("failed_with"),
    )
