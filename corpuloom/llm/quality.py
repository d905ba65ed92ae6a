"""Quality rules whose cutoffs are certified on labelled documents, by DataFrame expressions alone.

Each rule has a ladder of cutoffs from lenient to strict; level s of the ladders is the
rule set that rejects a document which passes the cutoff s of any rule.  A document's
severity is the first level that rejects it, so levels are nested.  On the labelled good
texts of a stratum that the base rules let through, a level with k false rejections among
n is certified if P(Bin(n, limit) <= k) <= error / strata, that is, if its share of false
rejections were over the limit, so few would be seen with no more than that chance.
Levels are tested in order up to the first that fails, which needs no correction of its
own; the division by the number of strata (Bonferroni) makes all certificates hold together
with chance 1 - error.  A stratum applies its last certified level, or none.

Texts are read once.  What follows is a narrow table of counts, kept by a checkpoint; the
sums by stratum and level are added up before they are shuffled.

Defined results: a null or wordless text has zero counts and fails the base rules; rows that
share a doc_id are judged each by its text; a document with several labels is good if any
says so, as are equal texts of a stratum, which count once; null labels, null doc_ids and
labels without a document certify nothing; a null stratum is a stratum; a stratum without
labelled texts rejects by the base rules alone; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, sized

#: The largest share of good texts of a stratum that the certified rules may reject, and the chance that any stratum's certificate is wrong.
LIMIT, ERROR = 0.05, 0.05
#: Words that a text needs, and the percentage of its words that may stand in repeated windows.
BASE_WORDS, BASE_REPEATED = 50, 50
#: Cutoffs from lenient to strict: what is above is rejected (short_words: what is below).  Shares in thousandths, mean word lengths in hundredths.
LADDERS = {
    "symbols": (1000, 700, 500, 350, 250, 180, 130, 100, 70, 50, 30, 20),
    "repeated_lines": (900, 800, 700, 600, 550, 500, 470, 440, 410, 390, 370, 350),
    "repeated_words": (490, 480, 470, 460, 450, 440, 420, 400, 380, 360, 340, 320),
    "short_words": (100, 130, 160, 180, 200, 220, 230, 240, 250, 260, 270, 280),
    "long_words": (2000, 1800, 1600, 1500, 1400, 1300, 1200, 1150, 1100, 1050, 1000, 950),
}
#: Strata that are joined by broadcast.
MOST_STRATA = 10_000

_SPACE = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]"


def _let(value: Column, then) -> Column:
    """then(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _repeated(w: Column) -> Column:
    """How many words stand in 3-word windows that are found twice or more.

    Windows are sorted by a hash with their place in the low bits, so that equal ones are neighbours;
    neighbours are compared word by word.  Hashes have 63 bits less those of the number of words.
    """
    n = F.size(w)
    call = F.call_function
    one = F.lit(1).cast("bigint")

    def windows(bits: Column) -> Column:
        place = lambda x: x.bitwiseAND(call("shiftleft", one, bits) - one).cast("int")
        packed = F.transform(F.sequence(F.lit(0), n - 3), lambda i: call("shiftleft", F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), bits).bitwiseOR(i.cast("bigint")))

        def covered(s: Column) -> Column:
            def same(j: Column) -> Column:
                a, b = F.get(s, j - 1), F.get(s, j)
                words = [F.get(w, place(a) + k) == F.get(w, place(b) + k) for k in range(3)]
                return (call("shiftrightunsigned", a, bits) == call("shiftrightunsigned", b, bits)) & words[0] & words[1] & words[2]

            pairs = F.filter(F.sequence(F.lit(1), F.size(s) - 1), same)
            places = F.sort_array(F.flatten(F.transform(pairs, lambda j: F.array(place(F.get(s, j - 1)), place(F.get(s, j))))))
            state = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(0).alias("end"))
            step = lambda t, p: F.struct((t["sum"] + p + 3 - F.greatest(p, t["end"])).cast("bigint").alias("sum"), (p + 3).alias("end"))
            return F.aggregate(places, state, step, lambda t: t["sum"])

        return _let(F.sort_array(packed), covered)

    return F.when(n >= 4, _let(F.ceil(F.log2(n.cast("double"))).cast("int"), windows)).otherwise(F.lit(0).cast("bigint"))


def measured(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep, and of the whole text: n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words."""
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(whole, _SPACE), "")
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(_WORD))
    of_words = _let(words, lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), F.aggregate(w, F.lit(0).cast("bigint"), lambda t, x: t + F.length(x)).alias("word_chars"), _repeated(w).alias("n_repeat_words")))
    of_lines = _let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines")))
    found = docs.select(*keep, of_words.alias("_w"), F.regexp_count(whole, F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"), of_lines.alias("_l"))
    return found.select(*keep, "_w.n_words", "_w.word_chars", "n_symbols", "_l.n_lines", "_l.n_dup_lines", "_w.n_repeat_words")


def values() -> dict[str, Column]:
    """What the cutoffs of each rule are held against, in whole numbers; texts without words are 0."""
    share = lambda part, of, scale: F.when(F.col(of) > 0, F.expr(f"{scale} * {part} div {of}")).otherwise(0)
    mean = share("word_chars", "n_words", 100)
    return {"symbols": share("n_symbols", "n_words", 1000), "repeated_lines": share("n_dup_lines", "n_lines", 1000), "repeated_words": share("n_repeat_words", "n_words", 1000), "short_words": mean, "long_words": mean}


def severity(ladders: dict[str, tuple[int, ...]] = LADDERS) -> Column:
    """The first level, from 1, at which any rule rejects; null if none does."""
    of, levels = values(), max(map(len, ladders.values()))
    rejects = lambda rule, at: (of[rule] < ladders[rule][at]) & (F.col("n_words") > 0) if rule == "short_words" else of[rule] > ladders[rule][at]
    at_level = [[rejects(rule, s) for rule in ladders if s < len(ladders[rule])] for s in range(levels)]
    found = F.lit(None).cast("int")
    for s in reversed(range(levels)):
        any_rule = at_level[s][0]
        for more in at_level[s][1:]:
            any_rule |= more
        found = F.when(any_rule, F.lit(s + 1)).otherwise(found)
    return found


def base_failed() -> Column:
    return (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEATED * F.col("n_words"))


def _log_factorial(x: Column) -> Column:
    """Stirling's series; x from 16 on, where its error is below 1e-12."""
    x = x.cast("double")
    return x * F.log(x) - x + F.log(2 * F.pi() * x) / 2 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5)))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k).

    Terms from k downwards are added in log space: all of them where few are below the mean; else those
    within 40 standard deviations of it, as the rest is below the smallest double.
    """
    mean = n * F.lit(p)
    reach = F.lit(40.0) * F.sqrt(mean)
    near = (mean > reach + 16) & (n - mean > reach + 16)
    first = F.when(near, F.floor(mean - reach)).otherwise(0).cast("bigint")
    at_zero = n * F.log(F.lit(1 - p))
    inside = _log_factorial(n) - _log_factorial(first) - _log_factorial(n - first) + first * F.log(F.lit(p)) + (n - first) * F.log(F.lit(1 - p))
    start = F.struct(F.lit(0.0).alias("sum"), F.when(near, inside).otherwise(at_zero).alias("log"))
    odds = F.log(F.lit(p / (1 - p)))
    step = lambda t, i: F.struct((t["sum"] + F.exp(t["log"])).alias("sum"), (t["log"] + F.log((n - i).cast("double") / (i + 1)) + odds).alias("log"))
    return F.when(k < first, 0.0).when(k >= n, 1.0).otherwise(F.aggregate(F.sequence(first, F.greatest(first, k)), start, step, lambda t: F.least(F.lit(1.0), t["sum"])))


def certified(counted: DataFrame, labels: DataFrame, levels: int, limit: float = LIMIT, error: float = ERROR) -> DataFrame:
    """_stratum, level (the last certified one, 0 if none), n_good and n_wrong (that the level rejects) of each stratum with labels.

    counted: _id, _stratum, _text (a hash), _failed and severity; labels: doc_id and quality.
    """
    good = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("_good"))
    # Repeated rows and copies meet before anything is joined or counted.
    texts = counted.where(F.col("_id").isNotNull() & ~F.col("_failed")).groupBy("_id", "_stratum", "_text").agg(F.max("severity").alias("severity"))
    once = texts.join(good, "_id").groupBy("_stratum", "_text").agg(F.max("_good").alias("_good"), F.max("severity").alias("severity"))
    by_level = once.where("_good = 1").groupBy("_stratum", "severity").agg(F.count("*").alias("n"))
    rejected = [F.coalesce(F.sum(F.when(F.col("severity") <= s, F.col("n"))), F.lit(0)).alias(f"_{s}") for s in range(1, levels + 1)]
    wide = by_level.groupBy("_stratum").agg(F.sum("n").alias("n_good"), F.array(*rejected).alias("_wrong"))
    strata = once.select("_stratum").distinct().agg(F.count("*").alias("_strata"))
    tails = F.transform("_wrong", lambda k: binomial_tail(F.col("n_good"), k, limit))
    # The one row of strata is the number that the error is divided by.
    passing = wide.join(F.broadcast(strata)).withColumn("level", F.size(F.filter(tails, lambda p: p <= F.lit(error) / F.col("_strata"))))
    return passing.select("_stratum", "level", "n_good", F.when(F.col("level") > 0, F.get("_wrong", F.col("level") - 1)).otherwise(0).alias("n_wrong"))


def judge(docs: DataFrame, labels: DataFrame, keys: list[str], stratum: str = "lang", ladders: dict[str, tuple[int, ...]] = LADDERS, limit: float = LIMIT, error: float = ERROR) -> DataFrame:
    """keys and the counts of measured(), base_failed, severity, level (certified for the stratum) and kept."""
    named = {f"_k{i}": k for i, k in enumerate(keys)}
    rows = docs.select(*(F.col(f"`{k}`").alias(n) for n, k in named.items()), F.col("doc_id").alias("_id"), F.col(f"`{stratum}`").alias("_stratum"), F.xxhash64("text").alias("_text"), "text")
    counted = cut(measured(rows, [*named, "_id", "_stratum", "_text"]).withColumn("_failed", base_failed()).withColumn("severity", severity(ladders)))
    found = cut(certified(counted, labels, max(map(len, ladders.values())), limit, error))
    levels = sized(found.select(F.col("_stratum").alias("_s"), "level"), MOST_STRATA)
    both = counted.join(levels, F.col("_stratum").eqNullSafe(F.col("_s")), "left")
    kept = ~F.col("_failed") & ~F.coalesce(F.col("severity") <= F.col("level"), F.lit(False))
    made = {"n_words": "n_words", "word_chars": "word_chars", "n_symbols": "n_symbols", "n_dup_lines": "n_dup_lines", "n_repeat_words": "n_repeat_words"}
    out = both.select(*named, *made, F.col("_failed").alias("base_failed"), kept.alias("kept"), "severity", F.coalesce("level", F.lit(0)).alias("level"))
    taken: list[str] = list(keys)
    for name in out.columns[len(named):]:
        other = fresh(name, taken)
        out = out.withColumnRenamed(name, other)
        taken.append(other)
    return out.select(*(F.col(n).alias(k) for n, k in named.items()), *out.columns[len(named):])
