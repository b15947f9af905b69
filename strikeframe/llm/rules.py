"""Quality rules: statistics of each text and a decision list learned from labelled ones, in DataFrame functions only.

Statistics are worked out within a row by array and string functions. The learner is sequential covering: labelled
rows are cut at the quantiles of each statistic; a rule grows by the threshold that gains most information on the
growing rows, is pruned to the prefix that does best on the pruning rows, and, if it is precise enough, the rows that it
covers are taken away and the next one is grown. Each step is one aggregation of the labelled rows to counts by
statistic, cut, label and part, so what reaches the driver has a fixed size. The rules aim at the rarer label; rows
that no rule covers have the other one. The list becomes one conditional expression whose branches are in the order of
the rules, so that the first rule that holds decides, and its text can be read.

Defined results: a null text has no words and fails the base rule; so does any text of fewer than 10 words; a long
text counts whole (its arrays are within one row, so its row must fit a task's memory); repeated rows are judged alike;
of several labels of one key the mean, rounded, counts; without labels of both kinds there are no rules and every
text that the base rule passes is kept; of equally good thresholds the one of the first statistic, and then the
smaller one, is taken; empty tables give empty tables; columns whose names clash with the results are left out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikeframe.llm.common import discard, written

WHITE = " \t\n\x0b\f\r"
_WHITE_CLASS = r"[\x20\x09-\x0D]+"
#: Words in a window for repeats; least words; most hundredths of words in repeated windows.
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20

#: Cuts of a statistic, rules, thresholds in a rule.
CUTS, MOST_RULES, MOST_LITERALS = 32, 12, 4
#: What a rule must reach: right among covered rows of both parts, and covered rows.
LEAST_PRECISION, LEAST_COVERED = 0.95, 4


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once for each row."""
    return F.transform(F.array(value), body)[0]


def _without(text: Column, characters: str) -> Column:
    """How many characters of a class the text has."""
    return F.length(text) - F.length(F.regexp_replace(text, f"{characters}+", ""))


def repeat_words(words: Column) -> Column:
    """Words within windows of WINDOW words that are found twice or more, the first included.

    Digests tell whether any window may repeat; where one does, windows are compared themselves: sorted, those equal
    to a neighbour are taken, and their places, in order, cover so many words.
    """
    size = F.size(words)
    places = F.sequence(F.lit(0), size - WINDOW)
    digests = F.transform(places, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW))))

    def covered(starts: Column) -> Column:
        gaps = F.transform(F.sequence(F.lit(0), F.size(starts) - 1), lambda k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - F.get(starts, k), F.lit(WINDOW))))
        return F.when(F.size(starts) == 0, 0).otherwise(F.aggregate(gaps, F.lit(0), lambda a, g: a + g))

    def among(s: Column) -> Column:
        def text(k: Column) -> Column:
            return F.get(s, k)["w"]

        twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.coalesce((k > 0) & (text(k) == text(k - 1)), F.lit(False)) | F.coalesce(text(k) == text(k + 1), F.lit(False)))
        return let(F.sort_array(F.transform(twice, lambda k: F.get(s, k)["i"])), covered)

    windows = F.transform(places, lambda i: F.struct(F.array_join(F.slice(words, i + 1, WINDOW), " ").alias("w"), i.alias("i")))
    return F.when(size < WINDOW, 0).when(F.size(F.array_distinct(digests)) == size - WINDOW + 1, 0).otherwise(let(F.sort_array(windows), among)).cast("long")


#: The counts of a text; the first five are the base statistics.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_marks")


def counted(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and COUNTS."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in COUNTS]
    whole = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(whole, F.lit(WHITE))
    rows = docs.select(
        *(F.col(f"`{c}`") for c in keep),
        whole.alias("__text__"),
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _WHITE_CLASS)).alias("__words__"),
        F.filter(F.split(whole, "\n"), lambda line: F.btrim(line, F.lit(WHITE)) != "").alias("__lines__"),
    )
    t, words, lines = F.col("__text__"), F.col("__words__"), F.col("__lines__")
    return rows.select(
        *(F.col(f"`{c}`") for c in keep),
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        _without(t, "[#*$%&|<>]").cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeat_words(words).alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.array_distinct(words)).cast("long").alias("n_distinct"),
        _without(t, r"\p{Lu}").cast("long").alias("n_upper"),
        _without(t, "[0-9]").cast("long").alias("n_digits"),
        _without(t, "[!?]").cast("long").alias("n_marks"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


#: What rules are made of: shares and sizes of the counts.
STATISTICS: dict[str, str] = {
    "symbols a character": "n_symbols / greatest(word_chars, 1)",
    "capitals a character": "n_upper / greatest(word_chars, 1)",
    "digits a character": "n_digits / greatest(word_chars, 1)",
    "exclamations a word": "n_marks / greatest(n_words, 1)",
    "repeated words a word": "n_repeat_words / greatest(n_words, 1)",
    "repeated lines a line": "n_dup_lines / greatest(n_lines, 1)",
    "different words a word": "n_distinct / greatest(n_words, 1)",
    "characters a word": "word_chars / greatest(n_words, 1)",
    "words a line": "n_words / greatest(n_lines, 1)",
    "words": "double(n_words)",
}


@dataclass(frozen=True)
class Literal:
    """One statistic compared with a threshold."""

    name: str
    above: bool
    threshold: float

    def holds(self) -> Column:
        value = F.expr(STATISTICS[self.name])
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Conjunctions in order; a text that one covers has the label ``found``, any other the opposite."""

    rules: tuple[tuple[Literal, ...], ...]
    found: int

    def number(self) -> Column:
        """The place, from 1, of the first rule that holds, or 0."""
        out = None
        for k, rule in enumerate(self.rules, 1):
            whole = rule[0].holds()
            for literal in rule[1:]:
                whole = whole & literal.holds()
            out = F.when(whole, k) if out is None else out.when(whole, k)
        return F.lit(0) if out is None else out.otherwise(0)

    def label(self) -> Column:
        return F.when(self.number() > 0, self.found).otherwise(1 - self.found)

    def reasons(self) -> list[str]:
        return [" and ".join(map(str, rule)) for rule in self.rules]


#: Counts of the target and of others on growing rows, and on pruning rows.
_Tally = tuple[int, int, int, int]


def _cuts(rows: DataFrame) -> list[list[float]]:
    """The distinct quantiles of each statistic, at most CUTS."""
    shares = [k / CUTS for k in range(1, CUTS)]
    found = rows.agg(*(F.percentile_approx(F.expr(e), shares, 100_000).alias(f"s{i}") for i, e in enumerate(STATISTICS.values()))).first()
    return [sorted(set(q or [])) for q in found]


def _bin(edges: Column, value: Column) -> Column:
    """How many cuts the value is above."""
    return F.size(F.filter(edges, lambda t: t < value))


def _tallies(rows: DataFrame, target: int, cuts: list[list[float]]) -> tuple[_Tally, dict[tuple[int, bool, int], _Tally]]:
    """The counts of all rows, and of those above and below each cut of each statistic, in one aggregation."""
    hit = F.col("label") == target
    each = rows.select(hit.alias("hit"), "prune", F.posexplode("bins").alias("s", "bin"))
    sums = each.groupBy("s", "bin").agg(*(F.count_if(F.expr(e)) for e in ("hit and not prune", "not hit and not prune", "hit and prune", "not hit and prune")))
    by: dict[int, dict[int, _Tally]] = {}
    for s, b, *n in sums.collect():  # statistics times cuts at most
        by.setdefault(s, {})[b] = tuple(n)
    total = tuple(map(sum, zip(*by[0].values(), strict=True))) if by else (0, 0, 0, 0)
    out = {}
    for s, bins in sorted(by.items()):
        below = (0, 0, 0, 0)
        for c in range(len(cuts[s])):
            below = tuple(a + b for a, b in zip(below, bins.get(c, (0, 0, 0, 0)), strict=True))
            out[s, False, c] = below
            out[s, True, c] = tuple(a - b for a, b in zip(total, below, strict=True))
    return total, out


def _gain(now: _Tally, then: _Tally) -> float:
    """Information gained on the target's growing rows."""
    if not then[0]:
        return 0.0
    return then[0] * (log2(then[0] / (then[0] + then[1])) - log2(now[0] / (now[0] + now[1])))


def _worth(tally: _Tally) -> float:
    """How right a rule is on the pruning rows."""
    return (tally[2] - tally[3]) / (tally[2] + tally[3] + 1)


def _grown(rows: DataFrame, target: int, cuts: list[list[float]]) -> tuple[list[tuple[int, bool, int]], _Tally]:
    """The best prefix of the conjunction that grows on ``rows``, with its counts; empty if none gains."""
    grown: list[tuple[int, bool, int]] = []
    worths: list[tuple[float, _Tally]] = []
    while len(grown) < MOST_LITERALS:
        now, then = _tallies(rows, target, cuts)
        if not now[0] or (grown and not now[1]):
            break
        best = max(then, key=lambda k: (_gain(now, then[k]), -k[0], -k[2]), default=None)
        if best is None or _gain(now, then[best]) <= 0:
            break
        grown.append(best)
        worths.append((_worth(then[best]), then[best]))
        rows = rows.where(_holds(best))
    if not grown:
        return [], (0, 0, 0, 0)
    keep = max(range(len(grown)), key=lambda i: (worths[i][0], -i))
    return grown[: keep + 1], worths[keep][1]


def _holds(literal: tuple[int, bool, int]) -> Column:
    s, above, cut = literal
    return F.col("bins")[s] > cut if above else F.col("bins")[s] <= cut


def learn(labelled: DataFrame, label: str = "label", key: str = "doc_id") -> DecisionList:
    """Fits a decision list on rows of COUNTS with a label, 0 or 1; a third of them, dealt by the key, prunes."""
    scratch: list[str] = []
    cuts = _cuts(labelled)
    edges = [F.array(*(F.lit(x) for x in c)).cast("array<double>") for c in cuts]
    bins = [_bin(e, F.expr(v)) for e, v in zip(edges, STATISTICS.values(), strict=True)]
    rows = labelled.select(F.array(*bins).alias("bins"), F.col(label).cast("int").alias("label"), (F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(3)) == 0).alias("prune"))
    rows = written(rows, "rules-labelled", scratch)
    sizes = dict(rows.groupBy("label").count().collect())
    target = 0 if sizes.get(0, 0) <= sizes.get(1, 0) else 1
    rules: list[tuple[Literal, ...]] = []
    names = list(STATISTICS)
    while len(rules) < MOST_RULES and len(sizes) == 2:
        literals, tally = _grown(rows, target, cuts)
        right, wrong = tally[0] + tally[2], tally[1] + tally[3]
        if not literals or right < LEAST_PRECISION * (right + wrong) or right + wrong < LEAST_COVERED:
            break
        rules.append(tuple(Literal(names[s], above, cuts[s][c]) for s, above, c in literals))
        whole = _holds(literals[0])
        for literal in literals[1:]:
            whole = whole & _holds(literal)
        rows = rows.where(~whole)
    discard(labelled.sparkSession, scratch)
    return DecisionList(tuple(rules), target)


def judged(
    docs: DataFrame, labels: DataFrame, known: Column, key: str = "doc_id", text: str = "text", label: str = "quality"
) -> DataFrame:
    """The key, the base statistics, base_failed, kept and rule: the first rule that holds, from 1, or 0.

    Labels are learned where ``known`` holds of their row, from the documents that the base rule passes.
    """
    stats = written(counted(docs, text, [key]), "rules-counts")
    told = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & known).groupBy(key).agg(F.round(F.avg(label)).cast("int").alias("label"))
    found = learn(stats.where(~base_failed()).join(told, key), "label", key)
    return stats.select(
        key, *COUNTS[:5], base_failed().alias("base_failed"), F.when(base_failed(), False).otherwise(found.label() == 1).alias("kept"), found.number().alias("rule")
    )
