"""Quality rules with risk-controlled thresholds, in SQL functions only.

Each rule rejects a document whose measure lies above a cutoff.  The cutoffs
are not tuned: a fixed chain of moves, each tightening one rule by one step of
its ladder, is tested on labelled documents, stratum by stratum.  What is
tested is the verdict of all rules together: after a move, the share of good
documents that any rule rejects.  The move is certified when, were that share
above the tolerated rate ``alpha``, as few rejections as were seen would have
a binomial probability of at most ``delta`` divided by the number of strata:
the exact (Clopper-Pearson) bound with Bonferroni's correction over strata.
Along the chain rejections only grow, so its moves are a fixed sequence that
needs no further share, and the last certified move holds.  With none, the
rules stay silent in that stratum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_CLASS, let, materialise, words_of

#: Rule: measure times ``scale`` over its base, and the ladder of cutoffs from lenient to strict.
RULES: dict[str, tuple[str, str, int, tuple[int, ...]]] = {
    "symbols": ("n_symbols", "word_chars", 1000, (320, 160, 80, 40, 20, 10, 5, 2, 1)),
    "upper": ("n_upper", "word_chars", 1000, (800, 600, 400, 300, 200, 100, 60, 40, 30)),
    "dup_lines": ("n_dup_lines", "n_lines", 100, (80, 60, 40, 30, 20, 10)),
    "repeats": ("n_repeat_words", "n_words", 100, (40, 30, 20, 15, 10, 5)),
    "word_length": ("word_chars", "n_words", 10, (150, 110, 90, 80, 70, 65, 60)),
}
#: The chain: one step of every ladder in turn.
MOVES = [(rule, ladder[step]) for step in range(max(len(r[3]) for r in RULES.values())) for rule, (_, _, _, ladder) in RULES.items() if step < len(ladder)]


def repeat_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more in the text."""
    at = lambda i: F.element_at(words, i)
    windows = F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.concat_ws(" ", at(i), at(i + 1), at(i + 2)))

    def covered(s: Column) -> Column:
        twice = lambda e, j: F.coalesce((e.k == F.get(s, j - 1).k) | (e.k == F.get(s, j + 1).k), F.lit(False))
        starts = F.transform(F.filter(s, twice), lambda e: e.i)
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))

    placed = lambda w: F.sort_array(F.transform(w, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    count = let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(let(placed(w), covered)))
    return F.when(F.size(words) < 4, 0).otherwise(count).cast("long")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The counts that the rules use, one row a document."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), text.alias("text"), words_of(text).alias("words"), F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_CLASS)).alias("lines"))
    without = lambda pattern: (F.length("text") - F.length(F.regexp_replace("text", pattern, ""))).cast("long")
    return base.select(
        "doc",
        "stratum",
        F.xxhash64("text").alias("body"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        without(r"[#*$%&|<>]").alias("n_symbols"),
        without(r"[A-Z]").alias("n_upper"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
    )


def exceeds(rule: str, cutoff: Column | int) -> Column:
    of, base, scale, _ = RULES[rule]
    return F.col(of) * scale > F.col(base) * cutoff


def binomial_cdf(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) for X ~ Bin(n, rate), by the recurrence of its terms' logarithms."""
    step = F.log(F.lit(rate / (1 - rate)))
    first = n * F.log(F.lit(1 - rate))
    add = lambda acc, i: F.struct((acc.t + F.log((n - i + 1) / i) + step).alias("t"), (acc.s + F.exp(acc.t + F.log((n - i + 1) / i) + step)).alias("s"))
    zero = F.struct(first.alias("t"), F.exp(first).alias("s"))
    return F.when(k <= 0, F.exp(first)).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))), zero, add, lambda acc: acc.s))


def first_moves() -> Column:
    """For each rule, the first move of the chain that rejects the document, or null."""
    of = lambda rule: F.array_min(F.array(*(F.when(exceeds(r, c), F.lit(k)) for k, (r, c) in enumerate(MOVES) if r == rule)))
    return F.array(*map(of, RULES))


def levels(measured: DataFrame, labelled: DataFrame, alpha: float, delta: float) -> DataFrame:
    """(stratum, n, level): the last certified move of each stratum, or null.

    ``labelled`` has doc and label; equal texts are one trial, good if all
    their labels are.  One aggregation counts every stratum's good texts and
    those that each move of the chain would reject; the tests run over those
    few sums.
    """
    texts = measured.filter(~F.col("base_failed")).join(labelled, "doc").groupBy("stratum", "body").agg(F.min("label").alias("label"), F.min(F.array_min("firsts")).alias("first")).filter("label = 1")
    sums = texts.groupBy("stratum").agg(F.count("*").alias("n"), F.array(*(F.count_if(F.col("first") <= k) for k in range(len(MOVES)))).alias("rejected"))
    # One row per stratum: the window counts strata, not documents.
    tried = sums.withColumn("strata", F.count("*").over(Window.partitionBy(F.lit(1)))).select("stratum", "n", "strata", F.posexplode("rejected").alias("move", "k"))
    passed = F.when(F.col("k") > F.col("n") * alpha, F.lit(False)).otherwise(binomial_cdf(F.col("k"), F.col("n"), alpha) <= F.lit(delta) / F.col("strata"))
    return tried.withColumn("passed", passed).groupBy("stratum", "n").agg(F.max(F.when(F.col("passed"), F.col("move"))).alias("level"))


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
    label_col: str = "quality",
    alpha: float = 0.02,
    delta: float = 0.05,
) -> DataFrame:
    """Judge every document by the base rules and the certified cutoffs.

    With a chance of at least 1 - ``delta``, the rules together falsely reject
    at most ``alpha`` of the good documents of every stratum.  Returns the
    document's id, the counts, ``base_failed``, ``kept`` and ``n_rules_failed``.

    A null or empty text has no words and fails the base rule; null strata
    form one stratum; null labels are ignored, repeated ones count as good
    only if all do, and equal texts are one trial; repeated documents are
    judged once each; a stratum needs some log(strata / delta) / alpha good
    texts, else only the base rules act; an empty table gives no rows.
    """
    base_failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    measured = measure(docs, id_col, text_col, stratum_col).withColumn("base_failed", base_failed)
    measured = materialise(measured.withColumn("firsts", first_moves()), "quality")
    labelled = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("doc")).agg(F.min(label_col).alias("label"))
    chosen = levels(measured, labelled, alpha, delta).select("stratum", "level")
    failed = F.coalesce(F.size(F.filter("firsts", lambda k: k <= F.col("level"))), F.lit(0)).cast("long")
    # One row per stratum; Spark broadcasts it only while it is below its own size threshold.
    judged = measured.join(chosen, "stratum", "left").withColumn("n_rules_failed", F.when(F.col("level").isNull(), F.lit(0).cast("long")).otherwise(failed))
    return judged.select(
        F.col("doc").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("n_rules_failed") == 0)).alias("kept"), "n_rules_failed",
    )


def oracle_sql(alpha: float = 0.02, delta: float = 0.05) -> str:
    over = lambda r, c: f"{RULES[r][0]} * {RULES[r][2]} > {RULES[r][1]} * {c}"
    of = lambda rule: "list_min([" + ", ".join(f"CASE WHEN {over(r, c)} THEN {k} END" for k, (r, c) in enumerate(MOVES) if r == rule) + "])"
    space = r"[^\x20\x09-\x0D]+"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, stratum, text, regexp_extract_all(text, '{space}') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{space}')) AS lines FROM d),
e AS (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
t AS (SELECT rid, i, word || ' ' || lead(word, 1) OVER p || ' ' || lead(word, 2) OVER p AS win FROM e WINDOW p AS (PARTITION BY rid ORDER BY i)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM t WHERE win IS NOT NULL) WHERE c >= 2),
cov AS (SELECT rid, count(DISTINCT i + o) AS n_repeat_words FROM rep, (VALUES (0), (1), (2)) s(o) GROUP BY rid),
m AS (SELECT w.rid, doc_id, stratum, text, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_upper,
  len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cov ON w.rid = cov.rid),
b AS (SELECT *, (n_words < 50 OR n_repeat_words * 100 > n_words * 50) AS base_failed, [{", ".join(map(of, RULES))}] AS firsts FROM m),
lab AS (SELECT doc_id, min(quality) AS label FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
txt AS (SELECT stratum, text, min(label) AS label, min(list_min(firsts)) AS first FROM b JOIN lab ON b.doc_id = lab.doc_id WHERE NOT base_failed GROUP BY stratum, text),
good AS (SELECT stratum, first FROM txt WHERE label = 1),
n AS (SELECT stratum, count(*) AS n FROM good GROUP BY stratum),
tried AS (SELECT n.stratum, n, move, (SELECT count(*) FROM good g WHERE g.stratum = n.stratum AND g.first <= move) AS k FROM n, range(0, {len(MOVES)}) s(move)),
terms AS (SELECT stratum, move, n, k, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({alpha}) + (n - i) * ln({1 - alpha}))) AS cdf
  FROM (SELECT *, unnest(range(0, least(k, floor(n * {alpha}))::BIGINT + 1)) AS i FROM tried) GROUP BY ALL),
chosen AS (SELECT stratum, max(move) AS level FROM terms WHERE k <= n * {alpha} AND cdf <= {delta} / (SELECT count(*) FROM n) GROUP BY stratum),
j AS (SELECT b.*, coalesce(len(list_filter(firsts, lambda x: x <= level)), 0)::BIGINT AS n_rules_failed FROM b LEFT JOIN chosen ON b.stratum = chosen.stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND n_rules_failed = 0) AS kept, n_rules_failed FROM j"""
