"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a boolean expression that is true where a document fails.  On a
random sample of a stated size each rule is timed, inside one job, and its
rejections are counted; the rules then run in the order of rejections per
second, as one CASE expression inside a lambda, so that a document which fails
early never meets the rules behind.  The order changes what a run costs, never
what it keeps.  Times are rounded to powers of two, so that runs agree on it.

``quality_filter`` computes nothing but what the cascade asks for.
``quality_scores`` reports the base features of every row, which it must
compute, and the cascade goes on from them: rules on base features cost a
comparison, the others read the text only of documents that no earlier rule
rejected.

Words are maximal runs of anything but ASCII white space.  The repeat counts
work inside the row: five-word windows are hashed to 64 bits, and only where a
hash occurs twice are the windows sorted to see which words they cover.

Cases: null text counts as empty and fails (no words); empty texts fail;
an empty table gives an empty result; ties, repeated rows and extra columns
are left as they are; a column named like a new one stays, and the new one gets
underscores.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import fresh, let, table

#: ASCII white space, as a character class and as characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
SYMBOL_CLASS = r"[#*$%&|<>]"
WINDOW = 5
#: Rows of the random sample that the rules are ordered by, on average; how often each is timed.
SAMPLE_ROWS, TIMES = 200, 2
#: Characters of a sampled text that rules are timed on.
SAMPLE_CHARS = 50_000


def words_of(text: Column) -> Column:
    """All words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """How many words lie in a five-word window that occurs at least twice."""
    n = F.size(words)
    hashes = F.transform(
        F.sequence(F.lit(1), n - (WINDOW - 1)),
        lambda i: F.xxhash64(*[F.get(words, i + (k - 1)) for k in range(WINDOW)]),
    )

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        starts = let(
            pairs,
            lambda s: F.array_sort(
                F.transform(
                    F.filter(
                        F.transform(s, lambda x, k: F.struct(x["i"].alias("i"), (F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))).alias("twice"))),
                        lambda x: x["twice"],
                    ),
                    lambda x: x["i"],
                )
            ),
        )
        # every window but the last adds as many words as lie before the next one, five at most
        zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("sum"))
        step = lambda acc, i: F.struct(i.alias("last"), (acc["sum"] + F.least(i - acc["last"], F.lit(WINDOW))).alias("sum"))
        return F.aggregate(starts, zero, step, lambda acc: acc["sum"])

    counted = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(n > WINDOW, counted).otherwise(F.lit(0))


def _dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    has_word = lambda line: F.length(F.trim(line, F.lit(SPACES))) > 0
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    count = lambda ls: let(F.array_distinct(ls), lambda d: F.when(F.size(d) == F.size(ls), F.lit(0)).otherwise(F.size(F.filter(ls, has_word)) - F.size(F.filter(d, has_word))))
    return let(lines, count)


@dataclass(frozen=True)
class Rule:
    """``failed`` builds, from the names of the feature columns, an expression that is true where a document fails."""

    name: str
    needs: tuple[str, ...]
    failed: object


def _lines(t: Column) -> Column:
    """Lines with a word, without white space around them."""
    return F.filter(F.transform(F.split(F.coalesce(t, F.lit("")), "\n", -1), lambda x: F.trim(x, F.lit(SPACES))), lambda x: x != "")


def _unlettered(w: Column) -> Column:
    return F.size(F.filter(w, lambda x: ~F.rlike(x, F.lit(r"\p{L}"))))


#: Features that every row of ``quality_scores`` has.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Each feature as an expression over a text and its words, put together only where a rule asks for it.
FEATURES = {
    "n_words": lambda t, w: F.size(w),
    "word_chars": lambda t, w: F.length(F.array_join(w, "")),
    "n_symbols": lambda t, w: F.coalesce(F.regexp_count(t, F.lit(SYMBOL_CLASS)), F.lit(0)),
    "n_dup_lines": lambda t, w: _dup_lines(t),
    "n_repeat_words": lambda t, w: _repeat_words(w),
    "n_lines": lambda t, w: F.size(_lines(t)),
    "n_unlettered": lambda t, w: _unlettered(w),
    "n_cut_lines": lambda t, w: F.size(F.filter(_lines(t), lambda x: F.endswith(x, F.lit("...")) | F.endswith(x, F.lit("…")))),
    "n_bullets": lambda t, w: F.size(F.filter(_lines(t), lambda x: F.rlike(x, F.lit("^[-*•‣]")))),
}


class Features(dict):
    """Features of a text by name: those that are known, and expressions for the others."""

    def __init__(self, t: Column, w: Column, known: dict[str, Column] | None = None) -> None:
        super().__init__(known or {})
        self._of = t, w

    def __missing__(self, name: str) -> Column:
        return FEATURES[name](*self._of)


#: The production rules.  The first two are the base; a document is kept if none of them fails it.
RULES = (
    Rule("few_words", ("n_words",), lambda f: f["n_words"] < 10),
    Rule("repeated_words", ("n_words", "n_repeat_words"), lambda f: f["n_repeat_words"] * 100 > f["n_words"] * 20),
    Rule("word_length", ("n_words", "word_chars"), lambda f: (f["word_chars"] < f["n_words"] * 2) | (f["word_chars"] > f["n_words"] * 20)),
    Rule("symbols", ("n_words", "n_symbols"), lambda f: f["n_symbols"] * 10 > f["n_words"]),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), lambda f: (f["n_dup_lines"] > 0) & (f["n_dup_lines"] * 2 > f["n_lines"])),
    Rule("unlettered_words", ("n_words", "n_unlettered"), lambda f: f["n_unlettered"] * 2 > f["n_words"]),
    Rule("cut_lines", ("n_lines", "n_cut_lines"), lambda f: f["n_cut_lines"] * 2 > f["n_lines"]),
    Rule("bullets", ("n_lines", "n_bullets"), lambda f: f["n_bullets"] * 10 > f["n_lines"] * 9),
)


def order_rules(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, known: tuple[str, ...] = ()) -> list[Rule]:
    """The rules by rejections per second on a random sample of about ``sample_rows`` rows of ``df``.

    Features that are ``known`` anyway cost nothing.
    """
    # of a longer text as much is timed as the driver may hold of each; what rules decide is decided on whole texts
    texts = df.select(F.substring(F.col(text).cast("string"), 1, SAMPLE_CHARS).alias("text"))
    n = texts.count()
    if not n:
        return list(rules)
    rows = texts.sample(min(1.0, sample_rows / n), 17).collect() or texts.take(1)
    spark = df.sparkSession
    sample = spark.createDataFrame(rows, "text string").withColumn("words", words_of(F.col("text"))).coalesce(1).persist()
    try:
        sample.count()

        def timed(row: Column) -> Column:
            t, w = row["text"], row["words"]

            def with_known(k: Column) -> Column:
                made = Features(t, w, {name: k[name] for name in known})
                clock = F.expr("CAST(reflect('java.lang.System', 'nanoTime') AS LONG)")
                fields = [clock.alias("t0")]
                for i, rule in enumerate(rules):
                    fields += [F.coalesce(rule.failed(made), F.lit(False)).alias(f"f{i}"), clock.alias(f"t{i + 1}")]
                return F.struct(*fields)

            return let(F.struct(*[FEATURES[name](t, w).alias(name) for name in known], F.lit(0).alias("_")), with_known)

        # the fields of a struct are evaluated in their order, so a clock between two rules parts their times
        measured = sample.select(let(F.struct("text", "words"), timed).alias("m"))
        sums = [F.sum(F.col(f"m.f{i}").cast("long")).alias(f"f{i}") for i in range(len(rules))]
        sums += [F.sum(F.col(f"m.t{i + 1}") - F.col(f"m.t{i}")).alias(f"t{i}") for i in range(len(rules))]
        runs = [measured.agg(*sums).first() for _ in range(TIMES)]
        cost = [max(1, min(r[f"t{i}"] for r in runs)) for i in range(len(rules))]
        step = [round(math.log2(c / min(cost))) for c in cost]
        return [rule for _, _, rule in sorted((-runs[0][f"f{i}"] / 2 ** step[i], i, rule) for i, rule in enumerate(rules))]
    finally:
        sample.unpersist()


def cascade(rules, made: dict[str, Column]) -> Column:
    """Name of the first rule that fails, null if none does: later rules are not computed for a document that failed."""
    verdict = None
    for rule in rules:
        verdict = F.when(rule.failed(made), F.lit(rule.name)) if verdict is None else verdict.when(rule.failed(made), F.lit(rule.name))
    return verdict


def quality_filter(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``df`` that no rule fails, all columns as they came."""
    ordered = order_rules(df, text, rules, sample_rows)
    # bound, not a column: a filter would put the splitting of the text in place of a column wherever it is used
    reason = let(words_of(F.col(text)), lambda w: cascade(ordered, Features(F.col(text), w)))
    return df.where(reason.isNull())


def quality_scores(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``df`` with struct ``quality``: the base features, and ``failed``, the first rule that fails in the sample's order (null: kept)."""
    ordered = order_rules(df, text, rules, sample_rows, BASE)

    def scored(w: Column) -> Column:
        base = F.struct(*[FEATURES[k](F.col(text), w).cast("long").alias(k) for k in BASE])
        judged = lambda m: F.struct(*[m[k].alias(k) for k in BASE], cascade(ordered, Features(F.col(text), w, {k: m[k] for k in BASE})).alias("failed"))
        return let(base, judged)

    (out,) = fresh(df, "quality")
    return df.withColumn(out, let(words_of(F.col(text)), scored))


def op3_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base features and verdict of every document."""
    q = quality_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n, r = F.col("quality.n_words"), F.col("quality.n_repeat_words")
    return q.select(
        "doc_id",
        *[F.col(f"quality.{k}") for k in BASE],
        ((n < 10) | (r * 100 > n * 20)).alias("base_failed"),
        F.col("quality.failed").isNull().alias("kept"),
    )


#: DuckDB SQL for the rows of op3_quality_cascade.
OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
lines AS (
  SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
wins AS (
  SELECT rid, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
dup AS (SELECT rid, i FROM wins QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
cov AS (SELECT rid, least(5, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 5)) AS c FROM dup),
rep AS (SELECT rid, sum(c)::BIGINT AS r FROM cov GROUP BY rid),
f AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
         len(list_filter(w, lambda x: NOT regexp_matches(x, '\p{L}'))) AS n_unlettered,
         len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_cut_lines,
         len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•‣]'))) AS n_bullets
  FROM d JOIN lines USING (rid) LEFT JOIN rep USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR 2 * n_unlettered > n_words OR 2 * n_cut_lines > n_lines
            OR 10 * n_bullets > 9 * n_lines) AS kept
FROM f
"""
