"""Learned quality rules: an ordered list of threshold conjunctions, applied as one Spark conditional expression.

Statistics of every text are computed by built-in functions, row by row. Rules are learned from the statistics of labelled rows
by sequential covering: a rule grows by the condition of largest information gain until it covers no good row, is pruned back
on rows that it wasn't grown on, and is kept while it is precise there; then the rows that it covers are set aside and the next rule is learned.
All counts are Spark aggregates over a table of the labelled rows' threshold cells; the driver sees a few hundred sums a step.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainweave.llm.common import SPACE_CHARS, chars_of, stored, unused, word_array

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Thresholds tried for each feature and class, evenly spread over its rows.
CUTS = 8
MAX_RULES = 10
MAX_CONDITIONS = 3
#: Share of junk that a rule needs among the rows it covers in the part it is pruned on.
MIN_PRECISION = 0.95
#: Junk rows that a rule needs there.
MIN_COVER = 5

#: Rates by which rules judge, each a whole number so that all engines agree on them.
FEATURES = {
    "words": "n_words",
    "word_length": "100 * word_chars div greatest(n_words, 1)",
    "symbol_rate": "1000 * n_symbols div greatest(word_chars, 1)",
    "dup_line_rate": "1000 * n_dup_lines div greatest(n_lines, 1)",
    "repeat_rate": "1000 * n_repeat_words div greatest(n_words, 1)",
    "distinct_rate": "1000 * n_distinct_words div greatest(n_words, 1)",
    "upper_rate": "1000 * n_upper div greatest(word_chars, 1)",
    "mark_rate": "1000 * n_marks div greatest(n_words, 1)",
    "digit_rate": "1000 * n_digits div greatest(word_chars, 1)",
}


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without its text column, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the further counts that features need.

    Words are `[^\\x20\\x09-\\x0D]+`. A null or empty text has no words and all counts 0. Texts are counted whole. Other columns
    pass through, except those with the names of counts, which counts replace.
    """
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper", "n_marks", "n_digits"]
    others = [F.col(f"`{c}`") for c in docs.columns if c != text and c.lower() not in counts]
    text_, words_, lines_, windows_, ordered_, places_ = unused(docs, "text", "words", "lines", "windows", "ordered", "places")
    t = F.coalesce(docs[f"`{text}`"], F.lit(""))
    rows = docs.select(*others, t.alias(text_), word_array(t).alias(words_), F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE_CHARS))) > 0).alias(lines_))
    n = F.size(words_)
    window = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words_, i), F.get(words_, i + 1), F.get(words_, i + 2)))
    # Windows are compared by 64-bit hashes. A hash set settles texts without equal windows, the usual case.
    rows = rows.withColumn(windows_, F.when(n >= 3, window).otherwise(F.array().cast("array<bigint>")))
    again = F.size(F.array_distinct(windows_)) < F.size(windows_)
    # Other texts' windows are sorted by hash; those with an equal neighbour keep their places, and each place adds the words that the one before it didn't cover.
    rows = rows.withColumn(ordered_, F.when(again, F.sort_array(F.transform(windows_, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda s, k: (F.get(ordered_, k)["h"] == s["h"])
    places = F.transform(ordered_, lambda s, k: F.when(F.coalesce(same(s, k - 1), F.lit(False)) | F.coalesce(same(s, k + 1), F.lit(False)), s["i"]))
    rows = rows.withColumn(places_, F.sort_array(F.filter(places, lambda i: i.isNotNull())))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(places_, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])
    long = lambda c, name: c.cast("long").alias(name)
    return rows.select(
        *others,
        long(n, "n_words"),
        long(F.char_length(F.translate(text_, SPACE_CHARS, "")), "word_chars"),
        long(chars_of(F.col(text_), SYMBOLS), "n_symbols"),
        long(F.size(lines_) - F.size(F.array_distinct(lines_)), "n_dup_lines"),
        long(F.coalesce(covered, F.lit(0)), "n_repeat_words"),
        long(F.size(lines_), "n_lines"),
        long(F.size(F.array_distinct(words_)), "n_distinct_words"),
        long(chars_of(F.col(text_), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "n_upper"),
        long(chars_of(F.col(text_), "!?"), "n_marks"),
        long(chars_of(F.col(text_), "0123456789"), "n_digits"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    """feature > cut, or not."""

    feature: str
    above: bool
    cut: int

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut}"

    def on(self, value: Column) -> Column:
        return value > self.cut if self.above else value <= self.cut


Rule = tuple[Condition, ...]


def learn_rules(statistics: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> list[Rule]:
    """Rules for junk (label 0), first to last. Rows without a label or statistics, and those that fail the base rules, teach nothing.

    A key with several labels counts as junk if any of them says so; a key with several rows counts once for each. Nothing learned (no
    labels, or only one class) gives an empty list.
    """
    marks = labels.select(labels[f"`{key}`"].alias("labelled"), labels[f"`{label}`"].alias("mark")).filter("mark IS NOT NULL AND labelled IS NOT NULL").groupBy("labelled").agg(F.min("mark").alias("mark"))
    known = statistics.filter(~base_failed()).withColumnRenamed(key, "id").select("id", *[F.expr(e).cast("long").alias(f) for f, e in FEATURES.items()]).join(marks, F.col("id") == F.col("labelled"))
    features = known.select((F.col("mark") == 0).alias("junk"), (F.pmod(F.xxhash64("id"), F.lit(3)) == 0).alias("held"), *FEATURES)
    features = stored(features, "quality-features")
    at = [(k + 0.5) / CUTS for k in range(CUTS)]
    quantiles = [F.percentile_approx(F.when(F.col("junk") == side, F.col(f)), at, 1000).alias(f"{f}_{int(side)}") for f in FEATURES for side in (False, True)]
    (found,) = features.agg(*quantiles).collect()
    cuts = {f: _with_middles(sorted({*(found[f"{f}_0"] or []), *(found[f"{f}_1"] or [])})) for f in FEATURES}
    # A row's cell: for each feature, the number of cuts below its value. Rows of a cell are alike to every rule.
    cell = [sum(((F.col(f) > c).cast("int") for c in cuts[f]), F.lit(0)).alias(f) for f in FEATURES]
    cells = features.select("junk", "held", *cell).groupBy("held", *FEATURES).agg(F.sum(F.col("junk").cast("long")).alias("p"), F.sum((~F.col("junk")).cast("long")).alias("n"))
    cells = stored(cells, "quality-cells")

    def met(rule: Rule) -> Column:
        out = F.lit(True)
        for c in rule:
            k = cuts[c.feature].index(c.cut)
            out = out & (F.col(c.feature) > k if c.above else F.col(c.feature) <= k)
        return out

    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        left = cells
        for r in rules:
            left = left.filter(~met(r))
        rule = _grow(left.filter(~F.col("held")), cuts, met)
        rule = rule and _prune(left.filter("held"), rule, met)
        if not rule:
            break
        rules.append(rule)
    return rules


def _with_middles(cuts: list[int]) -> list[int]:
    return sorted({*cuts, *((a + b) // 2 for a, b in zip(cuts, cuts[1:], strict=False))})


def _gain(p: int, n: int, before: tuple[int, int]) -> float:
    share = lambda p, n: math.log2(p / (p + n))
    return p * (share(p, n) - share(*before)) if p else 0.0


def _grow(cells: DataFrame, cuts: dict[str, list[int]], met) -> Rule:
    """Adds the condition of largest gain while good rows are covered. One aggregate a condition gives the sums of every bin of every feature."""
    rule: Rule = ()
    while len(rule) < MAX_CONDITIONS:
        bins = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("bin")) for f in FEATURES])).alias("b")
        sums = cells.filter(met(rule)).select(bins, "p", "n").groupBy("b.f", "b.bin").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).collect()
        total = tuple(sum(r[k] for r in sums if r["f"] == next(iter(FEATURES))) for k in ("p", "n"))
        if not total[0] or not total[1]:
            break
        best, ties = 0.0, []
        for f, at in cuts.items():
            own = {r["bin"]: (r["p"], r["n"]) for r in sums if r["f"] == f}
            for k, c in enumerate(at):
                high = tuple(sum(v[i] for b, v in own.items() if b > k) for i in (0, 1))
                for above, (p, n) in ((True, high), (False, (total[0] - high[0], total[1] - high[1]))):
                    gain = _gain(p, n, total)
                    if gain > best + 1e-9:
                        best, ties = gain, []
                    if ties or gain == best > 0:
                        ties += [Condition(f, above, c)] * (gain > best - 1e-9)
        if not ties:
            break
        # Of cuts of one feature that part the rows alike, the middle one keeps most away from both sides.
        ties = [t for t in ties if (t.feature, t.above) == (ties[0].feature, ties[0].above)]
        rule = (*rule, ties[len(ties) // 2])
    return rule


def _prune(cells: DataFrame, rule: Rule, met) -> Rule:
    """The precise part of a rule, from its first condition on, that does best on rows held back; empty if none is precise enough."""
    heads = [rule[: k + 1] for k in range(len(rule))]
    sums = cells.agg(*[F.coalesce(F.sum(F.when(met(h), F.col(x))), F.lit(0)).alias(f"{x}{k}") for k, h in enumerate(heads) for x in ("p", "n")]).first()
    scored = [((sums[f"p{k}"] - sums[f"n{k}"]) / max(1, sums[f"p{k}"] + sums[f"n{k}"]), -k, h) for k, h in enumerate(heads) if sums[f"p{k}"] >= MIN_COVER and sums[f"p{k}"] >= MIN_PRECISION * (sums[f"p{k}"] + sums[f"n{k}"])]
    return max(scored)[2] if scored else ()


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that a row's statistics meet, from 1; null if none."""
    out = F.when(F.lit(False), F.lit(0))
    for k, rule in enumerate(rules, 1):
        test = F.lit(True)
        for c in rule:
            test = test & c.on(F.expr(FEATURES[c.feature]))
        out = out.when(test, F.lit(k))
    return out


def apply_rules(statistics: DataFrame, rules: list[Rule]) -> DataFrame:
    """statistics with base_failed, kept and rule (the text of the rule that rejects the row, else null)."""
    names = F.array(*[F.lit(" and ".join(map(str, r))) for r in rules]) if rules else F.array(F.lit(None).cast("string"))
    failed = base_failed()
    number = verdict(rules)
    return statistics.withColumns({"base_failed": failed, "kept": ~failed & number.isNull(), "rule": F.when(~failed, F.get(names, number - 1))})


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """key, the counts of text_statistics, base_failed, kept and rule of every document.

    Repeated rows get repeated results, null keys are judged like others but never labelled, null texts count as empty, very long ones are
    counted whole, and an empty table gives an empty one. Ties of gain go to the middle cut of the first feature. Other columns are not read.
    """
    statistics = stored(text_statistics(docs.select(docs[f"`{key}`"], docs[f"`{text}`"]), text), "quality-statistics")
    return apply_rules(statistics, learn_rules(statistics, labels, key, label))
