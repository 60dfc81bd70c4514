"""Quality rules as weak supervision, in DataFrame functions only.

Rules look at whole-text statistics; each votes good, votes bad or abstains.  Votes
are counted by pattern (at most 3 to the number of rules), and
expectation-maximisation over the counted patterns estimates how accurate each
rule's good and bad votes are and how many documents are good.  The posterior
probability of a document's votes replaces an all-must-pass filter.  Rounds end when the
likelihood of the votes stops growing; nothing is held of a rule beforehand but one vote of each kind.

Every step is a Spark aggregation over the pattern table, which is small
whatever the input's size; one row of sums comes back for each round.

Defined results: null, empty and blank texts have no words; they fail the base rule.
Rows with null ids and repeated rows are judged by their text alone.  An empty table
gives an empty result.  A very long text is measured whole, in the task that has it.  Other columns pass through where ``keep`` asks for them; a column
that has the name of a statistic is replaced by it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.llm import common

WINDOW = 5
GOOD, BAD, ABSTAIN = 1, 0, 2


def _squeezed_length(text: Column, drop: str) -> Column:
    """Characters left when all runs of the class ``drop`` are gone."""
    return F.length(F.regexp_replace(text, drop, "")).cast("long")


def with_statistics(documents: DataFrame) -> DataFrame:
    """Add the statistics of each whole text.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words as the queries
    need them, and n_lines, n_upper, n_digits, n_marks for further rules.
    Repeated windows are found by 64-bit hashes of five words, within a row: no shuffle.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = documents.withColumn("_text", text)
    base = base.withColumn("_words", common.words_of(F.col("_text"))).withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(common.WORD_PATTERN)))
    base = base.withColumn("n_words", F.size("_words").cast("long")).withColumn(
        "_grams",
        F.when(
            F.size("_words") >= WINDOW,
            F.transform(F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col("_words"), i, WINDOW))),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    repeats = F.size("_grams") > F.size(F.array_distinct("_grams"))
    base = base.withColumn("_sorted", F.when(repeats, F.sort_array(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    same = lambda x, j: F.get(F.col("_sorted"), j)["g"].eqNullSafe(x["g"])
    base = base.withColumn("_starts", F.sort_array(F.transform(F.filter("_sorted", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"])))
    covered = F.aggregate(
        "_starts",
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last")),
        lambda acc: acc["n"],
    )
    t = F.col("_text")
    return base.withColumns(
        {
            "word_chars": _squeezed_length(t, common.SPACE_PATTERN),
            "n_symbols": _squeezed_length(t, r"[^#*$%&|<>]+"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
            "n_upper": _squeezed_length(t, r"[^A-Z]+"),
            "n_digits": _squeezed_length(t, r"[^0-9]+"),
            "n_marks": _squeezed_length(t, r"[^!?]+"),
            "n_letters": _squeezed_length(t, r"\P{L}+"),
            "n_symbol_runs": _squeezed_length(F.regexp_replace(F.regexp_replace(t, r"[^#*$%&|<>]+", " "), r"[^ ]+", "x"), " "),
            "n_distinct_words": F.size(F.array_distinct("_words")).cast("long"),
        }
    ).drop("_text", "_words", "_lines", "_grams", "_sorted", "_starts")


@dataclass(frozen=True)
class Rule:
    """A rule in SQL that Spark and others read alike: when it votes good and bad."""

    name: str
    good: str
    bad: str


#: The rules of the production query.  Integer arithmetic only, so that no rounding
#: decides a vote.  Kinds of junk are each seen by two rules or more: one vote alone, which
#: clean documents also get at times, seldom outweighs the others.
RULES = (
    Rule("length", "n_words >= 50", "n_words < 10"),
    Rule("symbols", "100 * n_symbols <= word_chars", "20 * n_symbols > word_chars"),
    Rule("symbol_runs", "50 * n_symbol_runs <= n_words", "5 * n_symbol_runs > n_words"),
    Rule("letters", "100 * n_letters >= 92 * word_chars", "100 * n_letters < 85 * word_chars"),
    Rule("repeats", "100 * n_repeat_words <= 5 * n_words", "100 * n_repeat_words > 20 * n_words"),
    Rule("lines", "n_lines >= 2 AND n_dup_lines = 0", "100 * n_dup_lines > 30 * n_lines"),
    Rule("distinct", "2 * n_distinct_words >= n_words", "3 * n_distinct_words < n_words"),
    Rule("word_length", "word_chars >= 3 * n_words AND word_chars <= 9 * n_words", "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
    Rule("capitals", "10 * n_upper <= 2 * word_chars", "10 * n_upper > 4 * word_chars"),
    Rule("marks", "20 * n_marks <= n_words", "4 * n_marks > n_words"),
    Rule("digits", "20 * n_digits <= word_chars", "4 * n_digits > word_chars"),
)

BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"
#: Rounds end when the log-likelihood of a document grows by less than this on average, or are this many.
TOLERANCE, MOST_ROUNDS = 1e-6, 100
#: Votes of each kind that a rule has cast on good and on bad documents before any is seen.
PSEUDO = 1.0


def votes_sql(rules: tuple[Rule, ...] = RULES) -> dict[str, str]:
    return {f"v_{r.name}": f"CASE WHEN {r.bad} THEN {BAD} WHEN {r.good} THEN {GOOD} ELSE {ABSTAIN} END" for r in rules}


@dataclass(frozen=True)
class Model:
    """Logarithms, once for good and once for bad documents: of their share, of the share of
    good votes of each rule, and of the share of bad votes of each rule."""

    good: tuple[float, ...]
    bad: tuple[float, ...]

    def log_odds(self, rules: tuple[Rule, ...]) -> Column:
        share, *added = (g - b for g, b in zip(self.good, self.bad))
        out = F.lit(share)
        for rule, good, bad in zip(rules, added, added[len(rules) :]):
            vote = F.col(f"v_{rule.name}")
            out = out + F.when(vote == GOOD, good).when(vote == BAD, bad).otherwise(0.0)
        return out

    def accuracy(self, rules: tuple[Rule, ...]) -> dict[str, tuple[float, float]]:
        """Rule to the share of its good votes on good documents and of its bad votes on bad ones."""
        n = len(rules)
        return {r.name: (math.exp(self.good[1 + i]), math.exp(self.bad[1 + n + i])) for i, r in enumerate(rules)}


def _logs(n: float, good: list[float], bad: list[float], total: float, pseudo: float) -> tuple[float, ...]:
    """One side of a model, from expected numbers of documents and of votes."""
    of_bad = [(b + pseudo) / (g + b + 2 * pseudo) for g, b in zip(good, bad)]
    return (math.log((n + 1) / (total + 2)), *[math.log(1 - x) for x in of_bad], *[math.log(x) for x in of_bad])


def fit(voted: DataFrame, rules: tuple[Rule, ...] = RULES, pseudo: float = PSEUDO, tolerance: float = TOLERANCE, most_rounds: int = MOST_ROUNDS) -> Model:
    """Expectation-maximisation over vote patterns, from the rows' majority votes.

    A model enters a round as two arrays of literals, so that all rounds run the same compiled code.
    """
    names = [f"v_{r.name}" for r in rules]
    half, width = 1 + len(names), 1 + 2 * len(names)
    cast = ", ".join(f"double({c} = {vote})" for vote in (GOOD, BAD) for c in names)
    patterns = voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).selectExpr("double(n) AS n", f"array(1D, {cast}) AS cast")
    patterns = common.materialize(patterns.coalesce(1), "quality-patterns")
    sums = [f"sum(n * {weight} * cast[{j}]) AS {side}_{j}" for j in range(width) for side, weight in (("good", "q"), ("bad", "(1 - q)"))]
    sums = [F.expr(s) for s in ("sum(n * (greatest(good, bad) + log1p(exp(-abs(good - bad))))) AS l", *sums)]
    added = lambda first, n: f"ln(1D + aggregate(slice(cast, {first}, {n}), 0D, (a, x) -> a + x))"
    as_good, as_bad = added(2, len(names)), added(1 + half, len(names))
    model, before = None, None
    for _ in range(most_rounds):
        # Exploding a single struct keeps the optimizer from repeating its expressions in every sum.
        rows = patterns.selectExpr("n", "cast", f"explode(array(struct({as_good} AS good, {as_bad} AS bad))) AS s").selectExpr("n", "cast", "s.good", "s.bad", "1D / (1D + exp(s.bad - s.good)) AS q")
        row = rows.agg(*sums).first()
        if row["l"] is None:
            return Model((0.0,) * width, (0.0,) * width)
        good, bad = ([row[f"{side}_{j}"] for j in range(width)] for side in ("good", "bad"))
        total = good[0] + bad[0]
        if model is not None and before is not None and row["l"] - before < tolerance * total:
            break
        before = row["l"] if model is not None else None
        model = Model(*(_logs(side[0], side[1:half], side[half:], total, pseudo) for side in (good, bad)))
        of = lambda side: f"aggregate(zip_with(cast, array({', '.join(f'{w!r}D' for w in side)}), (x, w) -> x * w), 0D, (a, x) -> a + x)"
        as_good, as_bad = of(model.good), of(model.bad)
    return model


def judge(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """``keep`` columns, the statistics, votes, base_failed, quality (posterior) and kept.

    Texts are read and measured once; the measured rows are stored in the shared
    folder, the model is fitted from their vote patterns and applied to them.
    """
    measured = with_statistics(documents)
    kept_columns = [F.col(c) for c in keep]
    stats = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_letters", "n_symbol_runs", "n_distinct_words")
    voted = measured.select(*kept_columns, *[c for c in stats if c not in keep]).withColumns({k: F.expr(v) for k, v in votes_sql(rules).items()}).withColumn("base_failed", F.expr(BASE_FAILED))
    stored = common.materialize(voted, "quality")
    log_odds = fit(stored, rules).log_odds(rules)
    verdict = ~F.col("base_failed") & (log_odds >= math.log(threshold / (1.0 - threshold)))
    return stored.withColumn("quality", 1.0 / (1.0 + F.exp(-log_odds))).withColumn("kept", verdict)


def judge_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for the rows of ``judge`` over ``documents``: statistics by plain list and
    window functions, and the rounds of expectation-maximisation by recursion."""
    drop = lambda pattern: f"length(regexp_replace(t, '{pattern}', '', 'g'))::BIGINT"
    names = [f"v_{r.name}" for r in rules]
    space, word = common.SPACE_PATTERN, common.WORD_PATTERN
    votes = ", ".join(f"{v} AS {k}" for k, v in votes_sql(rules).items())
    parts = [
        f"w AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}') AS ws FROM documents)",
        f"g AS (SELECT rid, i, list_slice(ws, i, i + {WINDOW - 1}) AS gram FROM (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w))",
        "r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1)",
        f"c AS (SELECT rid, sum(least({WINDOW}, coalesce(i - before, {WINDOW})))::BIGINT AS n FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM r) GROUP BY rid)",
        f"l AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS ls FROM w)",
        f"""s AS (SELECT w.rid, doc_id, len(ws)::BIGINT AS n_words, {drop(space)} AS word_chars, {drop('[^#*$%&|<>]+')} AS n_symbols,
            (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(ls)::BIGINT AS n_lines, {drop('[^A-Z]+')} AS n_upper,
            {drop('[^0-9]+')} AS n_digits, {drop('[^!?]+')} AS n_marks, {drop('[^' + chr(92) + 'p{L}]+')} AS n_letters,
            length(replace(regexp_replace(regexp_replace(t, '[^#*$%&|<>]+', ' ', 'g'), '[^ ]+', 'x', 'g'), ' ', ''))::BIGINT AS n_symbol_runs, len(list_distinct(ws))::BIGINT AS n_distinct_words
            FROM w JOIN l ON w.rid = l.rid LEFT JOIN c ON w.rid = c.rid)""",
        f"v AS (SELECT *, {BASE_FAILED} AS base_failed, {votes} FROM s)",
        f"p AS MATERIALIZED (SELECT {', '.join(names)}, count(*) AS n FROM v GROUP BY ALL)",
    ]
    goods, bads = (" + ".join(f"({c} = {x})::INT" for c in names) for x in (GOOD, BAD))
    sides = {"g": "q", "b": "(1 - q)"}
    sums = [f"sum(n * {w}) AS s_{z}" for z, w in sides.items()]
    sums += [f"sum(CASE WHEN {c} = {x} THEN n * {w} ELSE 0 END) AS {c}_{x}_{z}" for c in names for x in (GOOD, BAD) for z, w in sides.items()]
    share = lambda c, z: f"(({c}_{BAD}_{z} + {PSEUDO}) / ({c}_{GOOD}_{z} + {c}_{BAD}_{z} + {2 * PSEUDO}::DOUBLE))"
    made = [f"ln((s_{z} + 1) / (s_g + s_b + 2)) AS w_{z}" for z in sides]
    made += [f"ln({x}) AS {c}_w{vote}_{z}" for c in names for z in sides for vote, x in ((GOOD, f"1 - {share(c, z)}"), (BAD, share(c, z)))]
    weights = [m.rsplit(" AS ", 1)[1] for m in made]
    of = lambda z: f"(w_{z}" + "".join(f" + CASE {c} WHEN {GOOD} THEN {c}_w{GOOD}_{z} WHEN {BAD} THEN {c}_w{BAD}_{z} ELSE 0 END" for c in names) + ")"
    first = f"SELECT {', '.join(sums)} FROM (SELECT *, (({goods}) + 1.0::DOUBLE) / (({goods}) + ({bads}) + 2.0::DOUBLE) AS q FROM p)"
    again = f"""SELECT k, old, sum(n * (greatest(lg, lb) + ln(1 + exp(-abs(lg - lb))))) AS new, {", ".join(sums)}
        FROM (SELECT *, 1 / (1 + exp(lb - lg)) AS q FROM (SELECT k, l AS old, p.*, {of("g")} AS lg, {of("b")} AS lb FROM e, p)) GROUP BY k, old"""
    parts.append(f"""e AS (SELECT 1 AS k, NULL::DOUBLE AS l, {", ".join(made)} FROM ({first}) WHERE s_g IS NOT NULL
        UNION ALL SELECT k + 1, new, {", ".join(made)} FROM ({again}) WHERE (old IS NULL OR new - old >= {TOLERANCE} * (s_g + s_b)) AND k < {MOST_ROUNDS})""")
    parts.append(f"m AS (SELECT {', '.join(weights)} FROM e ORDER BY k DESC LIMIT 1)")
    return f"""WITH RECURSIVE {", ".join(parts)}
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND o >= 0 AS kept, round(1.0 / (1.0 + exp(-o)), 6) AS quality
        FROM (SELECT v.*, {of("g")} - {of("b")} AS o FROM v, m)"""
