"""Quality rules as a learned decision list, in DataFrame operations only.

Text statistics are native expressions.  Sequential covering learns from them:
a rule grows one threshold condition at a time by information gain, loses
conditions again while that raises its worth on held-back cells, and, if
precise enough there, takes the documents it covers out of what the next rule
sees.  The list is emitted as one ordered CASE expression.

The learner reads at most ``max_labelled`` labelled documents (a documented
bound, chosen by hash).  Spark bins their features and counts them per cell;
only those counts reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, WORD, materialize

#: Low bits of a packed window that hold its place in the text.
_PLACE_BITS = 24
_PLACE = (1 << _PLACE_BITS) - 1


def _same_window(words: str, i: Column, j: Column) -> Column:
    at = lambda k, d: F.get(F.col(words), k + d)
    return (at(i, 0) == at(j, 0)) & (at(i, 1) == at(j, 1)) & (at(i, 2) == at(j, 2))


def _neighbours_equal(array: str, equal) -> Column:
    """Elements of a sorted array that equal the one before or after them."""
    a = F.col(array)
    return F.filter(a, lambda x, i: (F.coalesce(equal(F.get(a, i - 1), x), F.lit(False)) & (i > 0)) | F.coalesce(equal(x, F.get(a, i + 1)), F.lit(False)))


def text_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_digits, n_chars and n_distinct_words added.

    A null text counts as an empty one.  n_repeat_words counts the words that
    stand in a window of three words which the text holds more than once.
    Windows are sorted as 64-bit numbers (40 bits of hash, 24 of place) and
    equal neighbours are confirmed word by word; a text with a false neighbour
    or more than 2**24 words is sorted by the windows' own text instead.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    cleared = "_text", "_words", "_packed", "_sorted", "_false", "_spelled", "_hits"
    d = df.withColumn("_text", text).withColumn("_words", F.filter(F.split("_text", BLANKS), lambda w: w != ""))
    w = F.col("_words")
    n = F.size(w)
    d = d.withColumn("n_words", n.cast("long"))
    hashed = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.lit(~_PLACE)).bitwiseOR(i.cast("long")))
    d = d.withColumn("_packed", F.when((n >= 3) & (n <= _PLACE), F.slice(hashed, 1, F.greatest(n - 2, F.lit(1)))))
    d = d.withColumn("_sorted", F.sort_array("_packed"))
    place = lambda x: x.bitwiseAND(F.lit(_PLACE)).cast("int")
    alike = lambda x, y: F.shiftright(x, _PLACE_BITS) == F.shiftright(y, _PLACE_BITS)
    s = F.col("_sorted")
    false = F.exists(F.transform(s, lambda x, i: (i > 0) & F.coalesce(alike(F.get(s, i - 1), x) & ~_same_window("_words", place(F.get(s, i - 1)), place(x)), F.lit(False))), lambda x: x)
    d = d.withColumn("_false", F.coalesce(false, n > _PLACE))
    spelled = F.sort_array(F.slice(F.transform(w, lambda x, i: F.struct(F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)).alias("s"), i.alias("p"))), 1, F.greatest(n - 2, F.lit(1))))
    d = d.withColumn("_spelled", F.when(F.col("_false") & (n >= 3), spelled))
    hits = F.when(
        F.col("_false"), F.transform(_neighbours_equal("_spelled", lambda x, y: x["s"] == y["s"]), lambda x: x["p"])
    ).otherwise(F.transform(_neighbours_equal("_sorted", alike), place))
    d = d.withColumn("_hits", F.sort_array(hits))
    h = F.col("_hits")
    covered = F.aggregate(
        F.transform(h, lambda p, i: F.least(F.coalesce(F.get(h, i + 1) - p, F.lit(3)), F.lit(3)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x
    )
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD))
    count = lambda pattern: F.regexp_count(F.col("_text"), F.lit(pattern)).cast("long")
    return d.withColumns(
        {
            "word_chars": F.length(F.regexp_replace("_text", BLANKS, "")).cast("long"),
            "n_symbols": count(r"[#*$%&|<>]"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
            "n_upper": count(r"\p{Lu}+"),
            "n_digits": count(r"[0-9]+"),
            "n_chars": F.length("_text").cast("long"),
            "n_distinct_words": F.size(F.array_distinct("_words")).cast("long"),
        }
    ).drop(*cleared)


#: The rules' features, per mille of what they are a share of.
def features() -> dict[str, Column]:
    per = lambda a, b: F.floor(1000 * F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("long")
    return {
        "f_word_length": per("word_chars", "n_words"),
        "f_symbols": per("n_symbols", "n_words"),
        "f_dup_lines": per("n_dup_lines", "n_words"),
        "f_repeats": per("n_repeat_words", "n_words"),
        "f_upper": per("n_upper", "n_words"),
        "f_digits": per("n_digits", "n_words"),
        "f_distinct": per("n_distinct_words", "n_words"),
        "f_words": F.col("n_words"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: int

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out


def labelled_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", label_id_col: str = "doc_id", max_labelled: int = 20_000, bins: int = 12):
    """(edges by feature, counts per cell).

    A cell is the bin numbers of all features, whether it is for growing (0)
    or pruning (1), and how many bad and good documents it holds.  Cells are
    at most as many as the labelled documents read.
    """
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(label_id_col).isNotNull())
        .groupBy(F.col(label_id_col).alias("_id"))
        .agg(F.min(label_col).alias("_label"))
        .withColumn("_order", F.xxhash64("_id"))
        .orderBy("_order", "_id")
        .limit(max_labelled)
    )
    seen = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_body")).join(F.broadcast(chosen), "_id")
    stats = text_statistics(seen, "_body").select("_order", (F.col("_label") == 0).cast("int").alias("bad"), *[c.alias(k) for k, c in features().items()])
    stats = materialize(stats, "quality-labelled")
    names = list(features())
    cuts = [i / bins for i in range(1, bins)] + [0.95, 0.98, 0.99]
    row = stats.agg(*[F.percentile_approx(k, cuts, 10_000).alias(k) for k in names]).first()
    edges = {k: sorted(set(row[k] or [])) for k in names}

    def bin_of(k: str) -> Column:
        return sum(((F.col(k) > e).cast("int") for e in edges[k]), F.lit(0)).alias(k)

    part = (F.pmod(F.shiftright("_order", 7), F.lit(3)) == 0).cast("int").alias("part")
    cells = stats.select(part, "bad", *[bin_of(k) for k in names]).groupBy("part", *names).agg(F.sum("bad").alias("bad"), F.count("*").alias("n")).collect()
    return edges, sorted(tuple(int(x) for x in r) for r in cells)


def learn(edges: dict[str, list[int]], cells: Sequence[tuple[int, ...]], max_rules: int = 12, max_conditions: int = 4, min_precision: float = 0.9, min_covered: int = 5) -> list[Rule]:
    """Rules that reject, in order.  No cells, or no precise rule: an empty list, which keeps everything."""
    if not cells:
        return []
    table = np.array(cells, dtype=np.int64)
    names = list(edges)
    part, bins, bad = table[:, 0], table[:, 1:-2], table[:, -2]
    good = table[:, -1] - bad
    tests = [(Condition(k, above, e), (bins[:, j] > i) if above else (bins[:, j] <= i)) for j, k in enumerate(names) for i, e in enumerate(edges[k]) for above in (True, False)]
    left, rules = np.ones(len(table), bool), []

    def counts(mask, which):
        m = mask & left & (part == which)
        return int(bad[m].sum()), int(good[m].sum())

    while len(rules) < max_rules:
        mask, chosen = np.ones(len(table), bool), []
        while len(chosen) < max_conditions:
            p0, n0 = counts(mask, 0)
            if not p0 or not n0:
                break
            best, gain = None, (1e-9, -math.inf)
            for t in tests:
                p, n = counts(mask & t[1], 0)
                if p:  # of equal gains the threshold that rejects less
                    g = round(p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))), 9), t[0].threshold if t[0].above else -t[0].threshold
                    if g > gain:
                        best, gain = t, g
            if best is None:
                break
            chosen.append(best)
            mask = mask & best[1]

        def worth(tests):
            m = np.ones(len(table), bool)
            for t in tests:
                m &= t[1]
            p, n = counts(m, 1)
            return (p - n) / (p + n) if p + n else -1.0, p, n, m

        while len(chosen) > 1 and worth(chosen[:-1])[0] >= worth(chosen)[0]:
            chosen.pop()
        if not chosen:
            break
        _, p, n, mask = worth(chosen)
        if p + n < min_covered or p / (p + n) < min_precision:
            break
        rules.append(Rule(tuple(t[0] for t in chosen)))
        left &= ~mask
    return rules


def rejected_by(rules: Sequence[Rule]) -> Column:
    """Number of the first rule that holds, from 1; 0 if none does."""
    out = None
    for i, r in enumerate(rules, 1):
        out = F.when(r.column(), F.lit(i)) if out is None else out.when(r.column(), F.lit(i))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _judged(rows: DataFrame, rules: Sequence[Rule], text_col: str) -> DataFrame:
    d = text_statistics(rows, text_col).withColumns(features())
    return d.withColumn("base_failed", base_failed()).withColumn("rule", rejected_by(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def judge_quality(docs: DataFrame, rules: Sequence[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text statistics, features, base_failed, rule, kept) of every row.

    Null and empty texts have no words and fail the base.  Repeated rows get
    equal verdicts; an empty table gives an empty result.
    """
    return _judged(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_body")), rules, "_body").drop("_body")


def kept_documents(docs: DataFrame, rules: Sequence[Rule], text_col: str = "text") -> DataFrame:
    """The rows that are kept, all columns as they were, whatever their names.

    Verdicts are written before rows are filtered by them: a filter pushed
    down into the statistics would compute them once for every place it names
    them in.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text_col).alias("_body"))
    return materialize(_judged(rows, rules, "_body").select("_row", "kept"), "quality-judged").where("kept").select("_row.*")


#: The base columns in SQL; the learned verdict has none.
BASE_ORACLE = """
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
windows AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS three FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, three) AS n FROM windows),
covered AS (SELECT doc_id, count(DISTINCT i + d) AS n_repeat_words FROM again, (SELECT unnest([0, 1, 2]) AS d) WHERE n > 1 GROUP BY 1),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM w),
counted AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols FROM w)
SELECT doc_id, n_words, word_chars, n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed
FROM counted JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
"""
