"""Quality rules as weak supervision, in DataFrame operations only.

Each rule votes a document good (1) or bad (0), or abstains. Expectation-maximisation over
the counts of vote patterns (at most 3 to the power of the number of rules, whatever the input)
estimates how often each rule is right about good and about bad documents, and how many
are good: a bad text mostly breaks a few rules only. The posterior
probability of being good, from all votes at once, replaces passing every rule.

Defined cases: a null or empty text has no words, and all rules that need words abstain; lines
without a word are no lines; repeated rows are judged each; an empty table gives none; columns of
the input that are called as those made here are replaced, others stay with ``judge``, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushgrid.llm.runtime import cut, ready

WINDOW = 8
MIN_WORDS = 20
#: Per cent of words in repeated windows, above which a text fails.
MAX_REPEATED = 30
BARE = "('#', '*', '$', '%', '&', '|', '<', '>')"
SPACE = r"[ \t-\r]+"
#: Expectation-maximisation: rounds; at first the share of good documents and how often a vote is right about a good and about a bad one; bounds of these two.
ROUNDS, GOOD, RIGHT, BOUNDS = 25, 0.9, (0.95, 0.3), ((0.7, 0.995), (0.05, 0.95))
KEEP_FROM = 0.5

#: name, vote for good, vote for bad; else the rule abstains. SQL that Spark and DuckDB both read, over the columns of stats().
RULES = [
    ("length", "n_words >= 50", "n_words < 20"),
    ("word_length", "n_words > 0 AND word_chars >= 3 * n_words AND word_chars <= 9 * n_words", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 14 * n_words)"),
    ("symbols", "n_words > 0 AND 100 * n_symbols <= n_words", "n_words > 0 AND 10 * n_symbols > n_words"),
    ("symbol_share", "200 * n_symbols <= word_chars AND n_words > 0", "100 * n_symbols > 3 * word_chars"),
    ("symbol_runs", "n_words > 0 AND n_runs = 0", "50 * n_runs > n_words"),
    ("bare_symbols", "n_words > 0 AND n_bare = 0", "20 * n_bare > n_words"),
    ("lines", "n_lines >= 2 AND n_dup_lines = 0", "n_lines >= 2 AND 10 * n_dup_lines > 3 * n_lines"),
    ("repetition", "n_words >= 20 AND 50 * n_repeat_words <= n_words", "n_words >= 20 AND 5 * n_repeat_words > n_words"),
    ("variety", "n_words >= 50 AND n_words <= 5000 AND 10 * n_distinct > 3 * n_words", "n_words >= 50 AND n_words <= 5000 AND 20 * n_distinct < 3 * n_words"),
    ("digits", "word_chars > 0 AND 50 * n_digits <= word_chars", "word_chars > 0 AND 5 * n_digits > word_chars"),
    ("sentences", "n_words >= 20 AND 50 * n_stops >= n_words", "n_words >= 100 AND 500 * n_stops < n_words"),
]
MORE = ("n_lines", "n_distinct", "n_digits", "n_stops", "n_runs", "n_bare")
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def stats(docs: DataFrame) -> DataFrame:
    """docs, without text, with the counts that the rules use, all long. Column text is read whole.

    Each step is a projection of its own: what several expressions use is computed once.
    """
    names = [F.col(f"`{c}`") for c in docs.columns if c not in (*STATS, *MORE, "text")]
    own = docs.select(F.struct(*names).alias("_row") if names else F.struct(F.lit(0)).alias("_row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    own = own.withColumn("_w", F.array_remove(F.split("_t", SPACE), ""))
    own = own.withColumn("_l", F.expr(r"filter(split(_t, '\n'), l -> l RLIKE r'[^ \t-\r]')"))
    own = own.withColumn("n_words", F.size("_w").cast("long")).withColumn("_c", F.array_join("_w", ""))
    own = own.withColumns({
        "word_chars": F.length("_c").cast("long"),
        "n_symbols": F.regexp_count("_c", F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_runs": F.regexp_count("_c", F.lit(r"[#*$%&|<>]{2,}")).cast("long"),
        "n_bare": F.expr(f"size(filter(_w, w -> w IN {BARE}))").cast("long"),
        "n_digits": F.regexp_count("_c", F.lit(r"[0-9]")).cast("long"),
        "n_stops": F.regexp_count("_c", F.lit(r"[.!?]")).cast("long"),
        "n_lines": F.size("_l").cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "n_distinct": F.size(F.array_distinct("_w")).cast("long"),
        "_h": F.expr(f"CASE WHEN size(_w) > {WINDOW} THEN transform(sequence(1, size(_w) - {WINDOW - 1}), i -> xxhash64(slice(_w, i, {WINDOW}))) END"),
    }).drop("_t", "_w", "_l", "_c")
    # places of windows that are there twice or more, in order; most texts have none and stop at the first test
    own = own.withColumn("_s", F.expr("CASE WHEN size(array_distinct(_h)) < size(_h) THEN sort_array(transform(_h, (h, i) -> named_struct('h', h, 'i', i))) END")).drop("_h")
    own = own.withColumn("_p", F.expr("CASE WHEN _s IS NOT NULL THEN sort_array(transform(filter(_s, (x, j) -> (j > 0 AND get(_s, j - 1).h = x.h) OR (j < size(_s) - 1 AND get(_s, j + 1).h = x.h)), x -> x.i)) END")).drop("_s")
    words = f"CASE WHEN _p IS NULL THEN 0L ELSE aggregate(transform(_p, (p, j) -> CASE WHEN j = size(_p) - 1 THEN {WINDOW}L ELSE least({WINDOW}L, CAST(get(_p, j + 1) - p AS BIGINT)) END), 0L, (a, x) -> a + x) END"
    return own.withColumn("n_repeat_words", F.expr(words)).select(*[F.col(f"_row.`{c}`") for c in docs.columns if c not in (*STATS, *MORE, "text")], *STATS, *MORE)


def votes(counted: DataFrame) -> DataFrame:
    """counted with one column a rule: 1, 0, or -1 for no vote."""
    return counted.withColumns({f"vote_{name}": F.expr(f"CASE WHEN {good} THEN 1 WHEN {bad} THEN 0 ELSE -1 END") for name, good, bad in RULES})


Rights = list[tuple[float, float]]


def _within(x: float, bounds: tuple[float, float]) -> float:
    return min(max(x, bounds[0]), bounds[1])


def estimate(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[float, Rights]:
    """(share of good documents, how often each rule is right about good and bad ones) from counts of vote patterns, by expectation-maximisation."""
    good, right = GOOD, [RIGHT] * len(RULES)
    for _ in range(ROUNDS):
        all_ = goods = 0.0
        of_good, of_bad = ([[0.0, 0.0] for _ in RULES] for _ in range(2))  # weight of votes, and of right ones
        for pattern, count in patterns:
            p = posterior(pattern, good, right)
            all_ += count
            goods += count * p
            for j, v in enumerate(pattern):
                if v >= 0:
                    of_good[j][0] += count * p
                    of_good[j][1] += count * p * v
                    of_bad[j][0] += count * (1 - p)
                    of_bad[j][1] += count * (1 - p) * (1 - v)
        good = _within((goods + 1) / (all_ + 2), (0.01, 0.99))
        right = [(_within((g[1] + RIGHT[0]) / (g[0] + 1), BOUNDS[0]), _within((b[1] + RIGHT[1]) / (b[0] + 1), BOUNDS[1])) for g, b in zip(of_good, of_bad, strict=True)]
    return good, right


def weights(right: tuple[float, float]) -> tuple[float, float]:
    """What a good and a bad vote of a rule add to the log odds."""
    return math.log(right[0] / (1 - right[1])), math.log((1 - right[0]) / right[1])


def posterior(pattern: tuple[int, ...], good: float, right: Rights) -> float:
    odds = math.log(good / (1 - good)) + sum(weights(r)[1 - v] for v, r in zip(pattern, right, strict=True) if v >= 0)
    return 1 / (1 + math.exp(-odds))


def judge(docs: DataFrame) -> DataFrame:
    """docs (without text) with the counts, votes, base_failed, posterior and kept.

    The counts are dear and narrow: they are computed once and kept in the shared folder.
    """
    ready(docs.sparkSession)
    counted = cut(votes(stats(docs)))
    names = [f"vote_{r[0]}" for r in RULES]
    rows = counted.groupBy(*names).count().collect()  # at most 3 ** len(RULES), by the rules' number alone
    good, right = estimate(sorted((tuple(r)[:-1], r["count"]) for r in rows))
    odds = F.lit(math.log(good / (1 - good)))
    for name, r in zip(names, right, strict=True):
        for_good, for_bad = weights(r)
        odds = odds + F.when(F.col(name) == 1, for_good).when(F.col(name) == 0, for_bad).otherwise(0.0)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    out = counted.withColumn("base_failed", failed).withColumn("posterior", 1 / (1 + F.exp(-odds)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= KEEP_FROM))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", *STATS, "base_failed", "kept")


def _sql() -> str:
    """The whole query in DuckDB: the rounds of estimation are as many small tables."""
    names = [r[0] for r in RULES]
    vote = ", ".join(f"CASE WHEN {good} THEN 1 WHEN {bad} THEN 0 ELSE -1 END AS v_{name}" for name, good, bad in RULES)

    def odds(t: str) -> str:
        return f"ln({t}.good / (1 - {t}.good))" + "".join(f" + CASE v_{n} WHEN 1 THEN ln({t}.g_{n} / (1 - {t}.b_{n})) WHEN 0 THEN ln((1 - {t}.g_{n}) / {t}.b_{n}) ELSE 0 END" for n in names)

    def right(n: str, side: str, p: str, vote: str, i: int) -> str:
        return f"least(greatest((coalesce(sum(c * {p} * {vote}) FILTER (v_{n} >= 0), 0) + {RIGHT[i]}) / (coalesce(sum(c * {p}) FILTER (v_{n} >= 0), 0) + 1), {BOUNDS[i][0]}), {BOUNDS[i][1]}) AS {side}_{n}"

    rounds = [f"m0 AS (SELECT {GOOD}::DOUBLE AS good, " + ", ".join(f"{RIGHT[0]}::DOUBLE AS g_{n}, {RIGHT[1]}::DOUBLE AS b_{n}" for n in names) + ")"]
    for k in range(ROUNDS):
        both = ", ".join(right(n, "g", "p", f"v_{n}", 0) + ", " + right(n, "b", "(1 - p)", f"(1 - v_{n})", 1) for n in names)
        rounds.append(f"m{k + 1} AS MATERIALIZED (SELECT least(greatest((sum(c * p) + 1) / (sum(c) + 2), 0.01), 0.99) AS good, {both} FROM (SELECT patterns.*, 1 / (1 + exp(-({odds(f'm{k}')}))) AS p FROM patterns, m{k}))")
    return rf"""
WITH split AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM documents),
wins AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM split WHERE len(w) >= {WINDOW})),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM wins) WHERE c > 1),
spread AS (SELECT doc_id, sum(least({WINDOW}, coalesce(n - i, {WINDOW}))) AS r FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM again) GROUP BY doc_id),
joined AS (SELECT doc_id, w, l, array_to_string(w, '') AS c FROM split),
stats AS MATERIALIZED (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(c) AS BIGINT) AS word_chars,
    CAST(length(c) - length(regexp_replace(c, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(length(c) - length(regexp_replace(c, '[0-9]', '', 'g')) AS BIGINT) AS n_digits,
    CAST(length(c) - length(regexp_replace(c, '[.!?]', '', 'g')) AS BIGINT) AS n_stops, CAST(len(regexp_extract_all(c, '[#*$%&|<>]{{2,}}')) AS BIGINT) AS n_runs, CAST(len(list_filter(w, lambda x: x IN {BARE})) AS BIGINT) AS n_bare, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct, CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words FROM joined LEFT JOIN spread USING (doc_id)),
votes AS MATERIALIZED (SELECT *, {vote} FROM stats),
patterns AS MATERIALIZED (SELECT {", ".join(f"v_{n}" for n in names)}, count(*) AS c FROM votes GROUP BY ALL),
{", ".join(rounds)}
SELECT doc_id, {", ".join(STATS)}, base_failed, NOT base_failed AND p >= {KEEP_FROM} AS kept
FROM (SELECT votes.*, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed, 1 / (1 + exp(-({odds(f'm{ROUNDS}')}))) AS p FROM votes, m{ROUNDS})
"""


OP6_SQL = _sql()
