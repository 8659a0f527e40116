"""Quality rules: a decision list learned by sequential covering, applied as one ordered Spark conditional expression.

Everything here is DataFrame operations and SQL functions. A text's statistics are counted in one pass over its words and
lines; repeated 3-word windows are found by sorting the text's own windows, compared as strings, so nothing shuffles.

Learning (``learned``): labelled rows, at most TRAIN_ROWS (a parameter; the first by a hash of their ids, outside the
held-out fold) that do not fail the base rules, are cut into a growing and a pruning part. Each statistic has up to CUTS
thresholds, quantiles of the learning rows. A rule is grown for label 0 by the condition of the largest information gain,
from one small histogram (statistic, bin, label) of the rows that it still covers; the prefix of its conditions that is
best on the pruning part stays (``pruned``). Rows that a rule covers leave, and the next rule is grown, until a rule is not
PRECISE on the pruning part or covers fewer than LEAST of its rows. Thresholds then move halfway to the next value of a
learning row. The driver sees histograms of a fixed size only.

Defined results: null and empty texts have zero words and fail the base rules; null labels or ids are not learned from, of
several labels of an id the largest counts; without labels of both kinds there is no rule, and all that passes the base
rules is kept. Ties of gain go to the earlier statistic and threshold. Equal rows each get their result; other columns
stay in ``judged`` and are not read, but names that begin with _qr_ are reserved.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .quality import held_out

TRAIN_ROWS = 10_000
CUTS = 31
RULES = 16
CONDITIONS = 4
PRECISE = 0.9
LEAST = 5
WINDOW = 3
LEAST_WORDS = 50
REPEATED_PERCENT = 50

_SPACE = r"[\x20\x09-\x0D]"
_SYMBOLS = "#*$%&|<>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def at_least_twice(pairs: Column) -> Column:
    """Of structs (k, i), sorted here: the places i whose k another one has, ascending."""
    again = lambda s: F.filter(s, lambda x, j: (F.get(s, j - 1)["k"] == x["k"]) | (F.get(s, j + 1)["k"] == x["k"]))
    return let(F.sort_array(pairs), lambda s: F.sort_array(F.transform(again(s), lambda x: x["i"])))


def repeated_words(words: Column) -> Column:
    """Words in windows of three that the array holds twice or more, the first included. Windows without an equal hash are
    alone; only the others are compared as strings."""
    later = range(1, WINDOW)
    hashes = F.transform(F.slice(words, 1, F.greatest(F.size(words) - (WINDOW - 1), F.lit(0))), lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in later)))
    maybe = lambda h: at_least_twice(F.transform(h, lambda x, i: F.struct(x.alias("k"), i.alias("i"))))
    window = lambda i: F.struct(F.concat_ws(" ", *(F.get(words, i + k) for k in range(WINDOW))).alias("k"), i.alias("i"))
    covered = lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, b: a + b)
    found = lambda h: let(at_least_twice(F.transform(maybe(h), window)), covered)
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(found(h)))


def without(text: Column, characters: str) -> Column:
    return F.char_length(F.translate(text, characters, ""))


def counted(docs: DataFrame) -> DataFrame:
    """docs and a struct ``_qr_n`` of counts: those of the contract, and those that the statistics need."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, _SPACE + "+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            repeated_words(w).alias("n_repeat_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.size(F.filter(w, lambda x: F.char_length(x) <= 3)).cast("long").alias("short"),
        ),
    )
    of_lines = let(lines, lambda s: F.struct(F.size(s).cast("long").alias("lines"), (F.size(s) - F.size(F.array_distinct(s))).cast("long").alias("n_dup_lines")))
    # the classes of characters are counted on what is left without small letters and white space
    kinds = {"n_symbols": _SYMBOLS, "loud": "!?", "digits": "0123456789", "stops": ".,;:"}
    of_rest = let(
        F.regexp_replace(text, r"[a-zß-öø-ÿ\x20\x09-\x0D]+", ""),
        lambda t: F.struct(*((F.char_length(t) - without(t, c)).cast("long").alias(n) for n, c in kinds.items()), F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("capitals")),
    )
    return docs.withColumns({"_qr_w": of_words, "_qr_l": of_lines, "_qr_r": of_rest})


COUNTS = {
    "n_words": "_qr_w.n_words",
    "word_chars": "_qr_w.word_chars",
    "n_symbols": "_qr_r.n_symbols",
    "n_dup_lines": "_qr_l.n_dup_lines",
    "n_repeat_words": "_qr_w.n_repeat_words",
}


def _share(a: str, b: str) -> Column:
    return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))


def statistics() -> dict[str, Column]:
    """What rules speak of, over the columns of ``counted``."""
    w, r, line = "_qr_w.n_words", "_qr_r", "_qr_l.lines"
    return {
        "repeat_share": _share("_qr_w.n_repeat_words", w),
        "symbol_share": _share(f"{r}.n_symbols", "_qr_w.word_chars"),
        "dup_line_share": _share("_qr_l.n_dup_lines", line),
        "capital_share": _share(f"{r}.capitals", "_qr_w.word_chars"),
        "loud_share": _share(f"{r}.loud", w),
        "digit_share": _share(f"{r}.digits", "_qr_w.word_chars"),
        "stop_share": _share(f"{r}.stops", w),
        "short_share": _share("_qr_w.short", w),
        "word_length": _share("_qr_w.word_chars", w),
        "line_length": _share(w, line),
        "words": F.col(w).cast("double"),
    }


def base_failed() -> Column:
    n = F.col(COUNTS["n_words"])
    return (n < LEAST_WORDS) | (100 * F.col(COUNTS["n_repeat_words"]) > REPEATED_PERCENT * n)


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float
    bin: int  # of the threshold among the learner's

    def holds(self, values: dict[str, Column]) -> Column:
        return values[self.name] > self.threshold if self.above else values[self.name] <= self.threshold

    def on_bins(self) -> Column:
        at = F.col(f"_qr_{self.name}")
        return at > self.bin if self.above else at <= self.bin

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.threshold!r}"


Rule = tuple[Condition, ...]


@dataclass(frozen=True)
class Rules:
    """An ordered list of rules for rejection; a text that none covers is kept."""

    rules: tuple[Rule, ...]

    def number(self) -> Column:
        """The first rule that covers the text, from 1; null if none does. Over the columns of ``counted``."""
        values = statistics()
        out = F.lit(None).cast("int")
        for i, rule in reversed(list(enumerate(self.rules, 1))):
            holds = F.lit(True)
            for c in rule:
                holds = holds & c.holds(values)
            out = F.when(holds, F.lit(i)).otherwise(out)
        return out

    def __str__(self) -> str:
        return "\n".join(f"{i}. reject if {' and '.join(map(str, r))}" for i, r in enumerate(self.rules, 1))


def both(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.on_bins()
    return out


def binned(docs: DataFrame, labels: DataFrame, train_rows: int) -> tuple[DataFrame, dict[str, list[float]]]:
    """Learning rows as bins of their statistics (_qr_<name>), ``bad`` and ``grow``; and the thresholds between bins."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.select(F.col("doc_id").alias("_qr_id"), (F.col("quality") == 0).cast("long").alias("bad"), F.xxhash64("doc_id").alias("_qr_h")).orderBy("_qr_h", "_qr_id").limit(train_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_qr_id"))
    names = list(statistics())
    rows = counted(rows).filter(~base_failed()).select("bad", (F.pmod(F.col("_qr_h"), F.lit(3)) > 0).alias("grow"), *(c.alias(n) for n, c in statistics().items()))
    rows = cut(rows)
    at = F.array(*(F.lit((i + 1) / (CUTS + 1)) for i in range(CUTS)))
    found = rows.agg(*(F.percentile_approx(n, at, F.lit(10_000)).alias(n) for n in names)).first()
    cuts = {n: sorted(set(found[n] or [])) for n in names}
    bins = [sum(((F.col(n) > v).cast("int") for v in cuts[n]), F.lit(0)).alias(f"_qr_{n}") for n in names]
    return cut(rows.select("bad", "grow", *bins, *names)), cuts


def midway(rows: DataFrame, rules: list[Rule]) -> Rules:
    """The same rules with each threshold halfway between the learning rows' values that it parts."""
    used = sorted({(c.name, c.threshold) for r in rules for c in r})
    if not used:
        return Rules(())
    least = rows.agg(*(F.min(F.when(F.col(n) > t, F.col(n))).alias(f"v{i}") for i, (n, t) in enumerate(used))).first()
    to = {key: (key[1] + least[i]) / 2 for i, key in enumerate(used) if least[i] is not None}
    return Rules(tuple(tuple(replace(c, threshold=to.get((c.name, c.threshold), c.threshold)) for c in r) for r in rules))


def learned(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Rules:
    rows, cuts = binned(docs, labels, train_rows)
    names = list(cuts)
    rules: list[Rule] = []
    left = rows
    while len(rules) < RULES:
        rule = pruned(left, grown(left, cuts, names))
        if not rule:
            break
        rules.append(rule)
        left = left.filter(~both(rule))
    return midway(rows, rules)


def grown(left: DataFrame, cuts: dict[str, list[float]], names: list[str]) -> Rule:
    """Conditions added by FOIL's gain over the growing rows, until all that they cover is bad or none gains."""
    rule: Rule = ()
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"_qr_{n}").alias("bin")) for n in names)))
    while len(rule) < CONDITIONS:
        cells = left.filter(F.col("grow") & both(rule)).select("bad", each.alias("c")).groupBy("c.name", "c.bin").agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good")).collect()
        counts = {(c["name"], c["bin"]): (c["bad"], c["good"]) for c in cells}
        bad, good = (sum(v[i] for (n, _), v in counts.items() if n == names[0]) for i in (0, 1))
        if not bad or not good:
            break
        best, most = None, 1e-9
        for n in names:
            low = [0, 0]
            for b, threshold in enumerate(cuts[n]):
                low = [x + y for x, y in zip(low, counts.get((n, b), (0, 0)))]
                for above, (p, q) in ((True, (bad - low[0], good - low[1])), (False, tuple(low))):
                    if p and (gain := p * (math.log2(p / (p + q)) - math.log2(bad / (bad + good)))) > most:
                        best, most = Condition(n, above, threshold, b), gain
        if best is None:
            break
        rule += (best,)
    return rule


def pruned(left: DataFrame, rule: Rule) -> Rule:
    """The prefix of the rule with the largest (bad - good) / (bad + good) on the pruning rows; none if it is not precise."""
    if not rule:
        return ()
    prefixes = [rule[:k] for k in range(1, len(rule) + 1)]
    sums = [F.sum(F.when(both(p), v)).alias(f"{name}{k}") for k, p in enumerate(prefixes) for name, v in (("bad", F.col("bad")), ("good", 1 - F.col("bad")))]
    got = left.filter(~F.col("grow")).agg(*sums).first()
    worth = []
    for k, p in enumerate(prefixes):
        bad, good = got[f"bad{k}"] or 0, got[f"good{k}"] or 0
        if bad + good >= LEAST and bad >= PRECISE * (bad + good):
            worth.append(((bad - good) / (bad + good), -k, p))
    return max(worth)[2] if worth else ()


def judged(docs: DataFrame, rules: Rules) -> DataFrame:
    """docs, the counts, base_failed, ``rule`` (the number of the first that covers the text) and kept."""
    out = counted(docs).withColumns({"base_failed": base_failed(), "rule": rules.number()})
    out = out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    return out.withColumns({n: F.col(c) for n, c in COUNTS.items()}).drop("_qr_w", "_qr_l", "_qr_r")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept; one row for each row of docs."""
    return judged(docs.select("doc_id", "text"), learned(docs, labels)).select("doc_id", *COUNTS, "base_failed", "kept")
