"""Quality rules: text statistics and learned decision lists, in SQL functions only.

A decision list is an ordered list of conjunctions of thresholds, each naming documents to drop. It is learned
from labelled statistics by sequential covering: a rule is grown on two thirds of the rows by adding the
threshold of the greatest information gain, pruned on the other third by cutting conditions from its end while
precision does not fall, and kept if it is precise enough on both parts; the rows that it covers are set aside and the
next rule is grown. A rule that isn't precise enough is dropped and another is grown without its conditions. The list becomes one CASE expression.

A window of three words is repeated if its sorted hash meets the same one; where equal hashes stand for different words (a text
in which that happens is judged again by the words themselves), so counts are exact.

The fit uses at most ``sample`` labelled rows (default 20000, those with the smallest hash of doc_id);
statistics cover all rows and whole texts. Statistics are computed once and written to the shared folder.

Defined cases: null or empty text has no word and fails the base rule; documents with several labels that
differ do not train; without labels of both kinds the list is empty and keeps everything that passes the base
rule; repeated rows are judged alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeleaf.llm.common import written

BLANKS = r"[\x20\x09-\x0D]+"
# Fixed value: the symbols that the rules count.
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FEATURES = ("n_words", "mean_word", "symbol_ratio", "bang_ratio", "upper_ratio", "dup_line_ratio", "repeat_ratio")


def _dropped(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def statistics(docs: DataFrame, keep: list[str] | None = None, window_hash=F.xxhash64) -> DataFrame:
    """``keep`` columns (default doc_id) with the counts of every whole text."""
    keep = keep or ["doc_id"]
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    rows = docs.select(*keep, words.alias("_w"), F.when(text.contains("\n"), lines).otherwise(F.array().cast("array<string>")).alias("_lines"))
    rows = rows.select("*", F.array_join("_w", "").alias("_joined"), F.size("_w").alias("_n"))
    at = lambda i: F.get(F.col("_w"), i)
    grams = F.when(F.col("_n") >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.col("_n") - 3), lambda i: F.struct(window_hash(at(i), at(i + 1), at(i + 2)).alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    rows = rows.withColumn("_grams", grams)

    def same(a: Column, b: Column) -> Column:
        return (a["h"] == b["h"]) & (at(a["i"]) == at(b["i"])) & (at(a["i"] + 1) == at(b["i"] + 1)) & (at(a["i"] + 2) == at(b["i"] + 2))

    def twice(grams, equal) -> Column:
        found = F.filter(grams, lambda x, k: F.coalesce(equal(x, F.get(grams, k - 1)), F.lit(False)) | F.coalesce(equal(x, F.get(grams, k + 1)), F.lit(False)))
        return F.sort_array(F.transform(found, lambda x: x["i"]))

    g = F.col("_grams")
    clash = F.exists(F.sequence(F.lit(1), F.size(g) - 1), lambda k: (F.get(g, k - 1)["h"] == F.get(g, k)["h"]) & ~same(F.get(g, k - 1), F.get(g, k)))
    # words hold no blank, so windows joined by blanks are equal only if their words are
    spelled = F.sort_array(F.transform(F.sequence(F.lit(0), F.col("_n") - 3), lambda i: F.struct(F.concat_ws(" ", at(i), at(i + 1), at(i + 2)).alias("h"), i.alias("i"))))
    exact = F.element_at(F.transform(F.array(spelled), lambda s: twice(s, lambda a, b: a["h"] == b["h"])), 1)
    rows = rows.withColumn("_twice", F.when((F.size(g) > 1) & clash, exact).otherwise(twice(g, same)))
    # each place covers three words, less what the next place covers already
    cover = F.aggregate("_twice", F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")), lambda acc: acc["n"])
    return rows.select(
        *keep,
        F.col("_n").cast("long").alias("n_words"),
        F.length("_joined").cast("long").alias("word_chars"),
        _dropped(F.col("_joined"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        cover.cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        _dropped(F.col("_joined"), "!").cast("long").alias("n_bangs"),
        _dropped(F.col("_joined"), UPPER).cast("long").alias("n_upper"),
    )


def features() -> dict[str, Column]:
    over = lambda a, b: F.col(a) / F.greatest(F.lit(1), F.col(b))
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": over("word_chars", "n_words"),
        "symbol_ratio": over("n_symbols", "word_chars"),
        "bang_ratio": over("n_bangs", "word_chars"),
        "upper_ratio": over("n_upper", "word_chars"),
        "dup_line_ratio": over("n_dup_lines", "n_lines"),
        "repeat_ratio": over("n_repeat_words", "n_words"),
    }


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def mask(self, table: dict[str, np.ndarray]) -> np.ndarray:
        x = table[self.feature]
        return x >= self.threshold if self.above else x <= self.threshold

    def column(self) -> Column:
        x = features()[self.feature]
        return x >= F.lit(self.threshold) if self.above else x <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<='} {self.threshold:.6g}"


def _covers(rule: list[Test], table: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    out = rows.copy()
    for t in rule:
        out &= t.mask(table)
    return out


def _grow(table, bad, rows, most: int, barred: set[Test], steps: int = 64) -> list[Test]:
    rule: list[Test] = []
    now = rows.copy()
    while len(rule) < most:
        p0, n0 = int((now & bad).sum()), int((now & ~bad).sum())
        if not p0 or not n0:
            break
        best = None
        for name, x in table.items():
            values = np.unique(np.quantile(x[now], np.linspace(0, 1, steps)))
            if len(values) < 2:
                continue
            cuts = (values[1:] + values[:-1]) / 2
            for above in (True, False):
                mask = x[now][:, None] >= cuts if above else x[now][:, None] <= cuts
                p, n = mask[bad[now]].sum(axis=0), mask[~bad[now]].sum(axis=0)
                gain = p * (np.log2(np.maximum(p, 1e-9) / np.maximum(p + n, 1)) - np.log2(p0 / (p0 + n0)))
                for k in np.argsort(-gain, kind="stable"):
                    test = Test(name, above, float(cuts[k]))
                    if test not in barred:
                        if p[k] and (best is None or gain[k] > best[0] + 1e-9):
                            best = (gain[k], test)
                        break
        if best is None or best[0] <= 1e-6:
            break
        rule.append(best[1])
        now &= best[1].mask(table)
    return rule


def learn(table: dict[str, np.ndarray], bad: np.ndarray, most_rules: int = 12, most_tests: int = 4, precision: float = 0.98, least: int = 2, most_dropped: int = 50, seed: int = 5) -> list[list[Test]]:
    """Rules for rows of class ``bad``, in order; a rule must hold ``precision`` on the pruning third (``least`` bad rows there, at least) and on all rows."""
    if not bad.any() or bad.all():
        return []
    third = np.random.default_rng(seed).integers(0, 3, len(bad)) == 0
    left, rules = np.ones(len(bad), bool), []
    barred: set[Test] = set()

    def precise(rule: list[Test], rows: np.ndarray, few: int) -> bool:
        got = _covers(rule, table, rows)
        p = int((got & bad).sum())
        return p >= few and p >= precision * int(got.sum())

    def worth(rule: list[Test]) -> float:
        got = _covers(rule, table, left & third)
        p, n = int((got & bad).sum()), int((got & ~bad).sum())
        return (p - n) / max(1, p + n)

    while len(rules) < most_rules and len(barred) < most_dropped and (left & bad & ~third).any():
        rule = _grow(table, bad, left & ~third, most_tests, barred)
        if not rule:
            break
        last = rule[-1]
        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        if precise(rule, left & third, least) and precise(rule, left, 1):
            rules.append(rule)
            left &= ~_covers(rule, table, left)
        else:
            barred.add(rule[-1] if len(rule) > 1 else rule[0])
            barred.add(last)
    return rules


def as_case(rules: list[list[Test]]) -> Column:
    """The number of the first rule that a row meets, 0 for none."""
    out = None
    for k, rule in enumerate(rules, 1):
        test = rule[0].column()
        for t in rule[1:]:
            test = test & t.column()
        out = F.when(test, k) if out is None else out.when(test, k)
    return F.lit(0) if out is None else out.otherwise(0)


def fit(stats: DataFrame, labels: DataFrame, sample: int = 20000, **options) -> list[list[Test]]:
    """Learn from the statistics of labelled documents (labels: doc_id, quality; 0 is bad)."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_low"), F.max("quality").alias("_high")).where("_low = _high")
    h = F.pmod(F.xxhash64(stats.doc_id), F.lit(1 << 30))
    rows = stats.join(known, "doc_id").select(*[c.alias(n) for n, c in features().items()], (F.col("_low") == 0).alias("bad"), h.alias("h"))
    n = rows.count()
    got = rows.where(F.col("h") < F.lit(int(min(1.0, sample / max(n, 1)) * (1 << 30)) + 1)).orderBy("h", *FEATURES).limit(sample).collect()
    table = {f: np.array([r[f] for r in got], float) for f in FEATURES}
    return learn(table, np.array([r["bad"] for r in got], bool), **options)


def judged(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, least_words: int = 50, most_repeat: int = 50, **options) -> DataFrame:
    """Statistics of each row with base_failed, the number of the rule that drops it (0: none) and kept."""
    stats = written(statistics(docs, keep), "quality")
    rules = fit(stats, labels, **options)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat * F.col("n_words"))
    out = stats.withColumn("base_failed", failed).withColumn("rule", as_case(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
