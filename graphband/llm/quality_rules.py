"""Quality rules as weak supervision, in DataFrame functions only.

Rules vote on a document or abstain.  Expectation-maximisation over the counts
of vote patterns (at most 3 to the number of rules, whatever the corpus) learns
how often each rule calls a bad document bad and a good one good, and how
common good documents are; the posterior probability of being good decides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphband.session import materialise

SPACES = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """Votes bad or good by SQL conditions over the measures; abstains where neither holds."""

    name: str
    bad: str
    good: str


#: Measures are exact counts, so both engines compare integers.
RULES = (
    Rule("symbols", "100 * n_symbols > 5 * word_chars", "100 * n_symbols <= word_chars"),
    Rule("shouting", "100 * n_upper > 40 * word_chars OR 100 * n_shouts > 20 * n_words", "100 * n_upper <= 20 * word_chars AND 100 * n_shouts <= 5 * n_words"),
    Rule("repeats", "100 * n_repeat_words > 12 * n_words", "100 * n_repeat_words <= 2 * n_words"),
    Rule("lines", "100 * n_dup_lines > 30 * n_lines", "100 * n_dup_lines <= 5 * n_lines"),
    Rule("word_length", "word_chars > 20 * n_words OR word_chars < 2 * n_words", "word_chars >= 3 * n_words AND word_chars <= 12 * n_words"),
    Rule("variety", "100 * n_distinct < 20 * n_words", "100 * n_distinct >= 35 * n_words"),
)
PRIOR, MISS, FALSE_ALARM = 0.85, 0.5, 0.01  # where expectation-maximisation starts
MOST_FALSE_ALARMS = 0.01  # rules are written to be precise: an estimate above this is taken for bad documents that were not told apart
PSEUDO = 2.0  # documents' worth of belief in the start
ROUNDS = 12


def measures(rows: DataFrame, key: str) -> DataFrame:
    """The column ``key`` and exact counts of every whole text; a null text has no words and no lines."""
    t = rows.select(key, F.coalesce("text", F.lit("")).alias("text"))
    t = t.select(
        key,
        "text",
        F.filter(F.split("text", SPACES + "+"), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(NOT_SPACE)).alias("lines"),
    )
    t = t.select(
        key,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("text", F.lit("!!")).cast("long").alias("n_shouts"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("codes"),
    )
    t = t.withColumn("n_distinct", F.size(F.array_distinct("codes")).cast("long"))
    window = lambda at: F.xxhash64(*[F.get("codes", at + i) for i in range(WINDOW)])
    last = F.size("codes") - WINDOW
    t = t.withColumn("windows", F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), window)))
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    # Only a text with an equal window sorts them: equal ones then stand side by side.
    ordered = F.when(repeats, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    t = t.withColumn("ordered", ordered).drop("windows", "codes")
    beside = lambda x, k: (x["h"] == F.get("ordered", k - 1)["h"]) | (x["h"] == F.get("ordered", k + 1)["h"])
    twice = F.filter("ordered", lambda x, k: F.coalesce(beside(x, k), F.lit(False)))
    t = t.withColumn("places", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("ordered")
    # A window adds the words up to the next repeated window, five at most.
    own = F.transform("places", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("places", k + 1) - p, F.lit(WINDOW))).cast("long"))
    covered = F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x)
    return t.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("places")


def _vote(rule: Rule) -> Column:
    """-1 bad, 1 good, 0 abstains."""
    return F.expr(f"CASE WHEN {rule.bad} THEN -1 WHEN {rule.good} THEN 1 ELSE 0 END").alias(f"v_{rule.name}")


def _log_odds(rules: tuple[Rule, ...], model: dict[str, float]) -> str:
    """SQL for the log odds of good to bad, given the votes."""
    terms = ["ln(p_good / (1 - p_good))"]
    terms += [f"CASE v_{r.name} WHEN -1 THEN ln(a_{r.name} / s_{r.name}) WHEN 1 THEN ln((1 - a_{r.name}) / (1 - s_{r.name})) ELSE 0 END" for r in rules]
    out = " + ".join(terms)
    for k, v in sorted(model.items(), key=lambda x: -len(x[0])):
        out = out.replace(k, f"{v!r}D")
    return out


def start(rules: tuple[Rule, ...]) -> dict[str, float]:
    """p_good; for each rule s_ (votes bad on bad documents) and a_ (votes bad on good ones: a false alarm)."""
    return {"p_good": PRIOR} | {f"s_{r.name}": 1 - MISS for r in rules} | {f"a_{r.name}": FALSE_ALARM for r in rules}


def fit(patterns: DataFrame, rules: tuple[Rule, ...] = RULES, rounds: int = ROUNDS) -> dict[str, float]:
    """Expectation-maximisation over vote patterns with their counts (v_..., n).

    The start's values count as PSEUDO documents in each estimate, so that no
    rate reaches 0 or 1, also where there are no documents at all.
    """
    model = start(rules)
    for _ in range(rounds):
        good = patterns.withColumn("g", F.expr(f"1D / (1D + exp(-({_log_odds(rules, model)})))"))
        sums = [F.sum("n").cast("double").alias("all"), F.sum(F.expr("n * g")).alias("good")]
        for r in rules:
            sums += [F.sum(F.expr(f"CASE WHEN v_{r.name} = -1 THEN n * (1D - g) ELSE 0D END")).alias(f"sb_{r.name}"), F.sum(F.expr(f"CASE WHEN v_{r.name} <> 0 THEN n * (1D - g) ELSE 0D END")).alias(f"sn_{r.name}")]
            sums += [F.sum(F.expr(f"CASE WHEN v_{r.name} = -1 THEN n * g ELSE 0D END")).alias(f"ab_{r.name}"), F.sum(F.expr(f"CASE WHEN v_{r.name} <> 0 THEN n * g ELSE 0D END")).alias(f"an_{r.name}")]
        x = {k: v or 0.0 for k, v in good.agg(*sums).first().asDict().items()}
        model = {"p_good": (x["good"] + PSEUDO * PRIOR) / (x["all"] + PSEUDO)}
        for r in rules:
            model[f"s_{r.name}"] = (x[f"sb_{r.name}"] + PSEUDO * (1 - MISS)) / (x[f"sn_{r.name}"] + PSEUDO)
            model[f"a_{r.name}"] = min(MOST_FALSE_ALARMS, (x[f"ab_{r.name}"] + PSEUDO * FALSE_ALARM) / (x[f"an_{r.name}"] + PSEUDO))
    return model


BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"
KEPT = "NOT base_failed AND posterior >= 0.5D"
COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_bad_votes", "posterior"]


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: counts, base_failed, kept, the number of bad votes and the posterior of being good.

    Documents that fail the base limits get no vote and teach nothing.  A
    null or empty text fails them.  Null ids and repeated rows are judged like
    any other; other columns are not read; an empty table gives no rows.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    measured = materialise(measures(rows, "doc_id"))
    votes = _votes(measured, rules)
    posterior = _posterior(votes, rules)
    bad = sum((F.when(F.col(f"v_{r.name}") == -1, 1).otherwise(0) for r in rules), F.lit(0)).cast("long")
    out = votes.withColumn("posterior", posterior).withColumn("n_bad_votes", bad)
    return out.withColumn("kept", F.expr(KEPT)).select(*COLUMNS)


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns.

    Rows and measures are written once and read twice, to learn and to filter; no text is shuffled.
    """
    rows = docs.select(F.struct("*").alias("whole"), docs[text_col].alias("text"))
    votes = _votes(materialise(measures(rows, "whole")), rules)
    return votes.withColumn("posterior", _posterior(votes, rules)).where(KEPT).select("whole.*")


def _votes(measured: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    return measured.withColumn("base_failed", F.expr(BASE_FAILED)).select("*", *map(_vote, rules))


def _posterior(votes: DataFrame, rules: tuple[Rule, ...]) -> Column:
    """Of a model that is fitted to these votes."""
    patterns = votes.where("not base_failed").groupBy(*[f"v_{r.name}" for r in rules]).agg(F.count(F.lit(1)).alias("n"))
    model = fit(materialise(patterns.coalesce(1)), rules)
    return F.round(F.expr(f"1D / (1D + exp(-({_log_odds(rules, model)})))"), 6)


def oracle_sql(rules: tuple[Rule, ...] = RULES, rounds: int = ROUNDS) -> str:
    """The same in DuckDB SQL, with expectation-maximisation unrolled."""
    names = ", ".join(f"v_{r.name}" for r in rules)
    votes = ", ".join(f"CASE WHEN {r.bad} THEN -1 WHEN {r.good} THEN 1 ELSE 0 END AS v_{r.name}" for r in rules)
    odds = "ln(p_good / (1 - p_good)) + " + " + ".join(f"CASE v_{r.name} WHEN -1 THEN ln(a_{r.name} / s_{r.name}) WHEN 1 THEN ln((1 - a_{r.name}) / (1 - s_{r.name})) ELSE 0 END" for r in rules)
    first = ", ".join(f"CAST({v!r} AS DOUBLE) AS {k}" for k, v in start(rules).items())
    ctes = [f"m0 AS (SELECT {first})"]
    for i in range(rounds):
        new = [f"(coalesce(sum(n * g), 0) + {PSEUDO} * CAST({PRIOR} AS DOUBLE)) / (coalesce(sum(n), 0) + {PSEUDO}) AS p_good"]
        for r in rules:
            for k, weight, at in (("s", "(1 - g)", 1 - MISS), ("a", "g", FALSE_ALARM)):
                hit, all_ = (f"coalesce(sum(CASE WHEN v_{r.name} {op} THEN n * {weight} ELSE 0 END), 0)" for op in ("= -1", "<> 0"))
                rate = f"({hit} + {PSEUDO} * CAST({at} AS DOUBLE)) / ({all_} + {PSEUDO})"
                new.append(f"{rate if k == 's' else f'least(CAST({MOST_FALSE_ALARMS} AS DOUBLE), {rate})'} AS {k}_{r.name}")
        ctes.append(f"m{i + 1} AS MATERIALIZED (SELECT {', '.join(new)} FROM (SELECT *, 1 / (1 + exp(-({odds}))) AS g FROM patterns, m{i}))")
    return rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
windows AS (SELECT rid, i, words[i:i + 4] AS win FROM w, unnest(range(1, len(words) - 3)) AS u(i) WHERE len(words) >= 5),
twice AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, win) > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, unnest(range(0, 5)) AS u(k) GROUP BY rid),
measured AS (SELECT w.rid, doc_id, CAST(len(words) AS BIGINT) AS n_words,
  CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(regexp_extract_all(text, '\p{{Lu}}')) AS BIGINT) AS n_upper,
  CAST(len(regexp_extract_all(text, '!!')) AS BIGINT) AS n_shouts,
  CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(len(list_distinct(words)) AS BIGINT) AS n_distinct, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN covered ON w.rid = covered.rid),
votes AS MATERIALIZED (SELECT *, ({BASE_FAILED}) AS base_failed, {votes} FROM measured),
patterns AS MATERIALIZED (SELECT {names}, count(*) AS n FROM votes WHERE NOT base_failed GROUP BY ALL),
{(',' + chr(10)).join(ctes)},
scored AS (SELECT votes.*, round(1 / (1 + exp(-({odds}))), 6) AS posterior FROM votes, m{rounds})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND posterior >= 0.5 AS kept,
  CAST({' + '.join(f'CAST(v_{r.name} = -1 AS INTEGER)' for r in rules)} AS BIGINT) AS n_bad_votes, posterior FROM scored
"""
