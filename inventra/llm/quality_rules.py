"""Quality rules: one threshold table compiled into one projection of built-in expressions.

Metrics come from one pass over a document's words and lines. A SQL lambda over a one-element array binds each
intermediate array once (a plain column would be inlined into the inner lambdas and evaluated for every element).

Defined cases: null text counts as empty; an empty text has 0 in every column and fails the base rule; texts of any
length are read whole; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_SQL

#: Common function words of the four languages.
STOP_WORDS = (
    "the of and to in a is that for it with as was on are be by this "
    "de la le et les des en un une du que qui est pour dans par sur au "
    "der die und den von zu das mit sich ist im dem nicht ein eine auf für "
    "el los las y se del por con una su para es al lo como"
).split()
WINDOW = 8


class Rule(NamedTuple):
    name: str
    metric: str
    low: float
    high: float


#: A document is kept if every metric lies within [low, high].
RULES: tuple[Rule, ...] = (
    Rule("length", "n_words", 20, float("inf")),
    Rule("repeated", "repeat_ratio", 0, 0.30),
    Rule("word_length", "mean_word_chars", 2, 15),
    Rule("symbols", "symbol_ratio", 0, 0.25),
    Rule("stop_words", "stop_ratio", 0.01, 1.0),
    Rule("lines", "dup_line_ratio", 0, 0.60),
)


def _bound(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def metrics_sql(text: str = "_text") -> str:
    hashed = ", ".join(f"h[i + {k}]" if k else "h[i]" for k in range(WINDOW))
    keys = f"if(size(h) <= {WINDOW}, cast(array() as array<bigint>), transform(sequence(0, size(h) - {WINDOW}), i -> xxhash64({hashed})))"
    # window starts whose key occurs again, in order; each adds the words that the one before has not covered
    again = "filter(s, (e, j) -> e.k = get(s, j - 1).k or e.k = get(s, j + 1).k)"
    starts = f"array_sort(transform({again}, e -> e.i))"
    covered = f"aggregate({starts}, named_struct('n', 0, 'at', -{WINDOW}), (a, x) -> named_struct('n', a.n + least({WINDOW}, x - a.at), 'at', x), a -> a.n)"
    repeats = _bound(keys, "k", f"if(size(array_distinct(k)) = size(k), 0, {_bound('array_sort(transform(k, (x, i) -> named_struct("k", x, "i", i)))', 's', covered)})")
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    lines = _bound(f"filter(split({text}, '\\n'), l -> l rlike {WORD_SQL})", "l", "size(l) - size(array_distinct(l))")
    of_words = (
        "named_struct('n_words', cast(size(w) as bigint), 'word_chars', aggregate(w, 0L, (a, x) -> a + length(x)), "
        f"'n_stop', size(filter(w, x -> x in ({stops}))), 'n_repeat_words', cast({_bound('transform(w, x -> xxhash64(x))', 'h', repeats)} as bigint), "
        f"'n_dup_lines', cast({lines} as bigint), 'n_lines', size(split({text}, '\\n')), "
        f"'n_symbols', cast(length({text}) - length(regexp_replace({text}, '[#*$%&|<>]+', '')) as bigint))"
    )
    return _bound(f"regexp_extract_all({text}, {WORD_SQL}, 0)", "w", of_words)


def verdict(rules: Sequence[Rule] = RULES) -> tuple[Column, Column]:
    """(kept, names of failed rules), over the metric columns."""
    failed = [F.when(~F.coalesce(F.col(r.metric).between(F.lit(float(r.low)), F.lit(float(r.high))), F.lit(False)), F.lit(r.name)) for r in rules]
    names = F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")
    return F.size(names) == 0, names


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and ratios of each document."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    df = df.select("doc_id", F.expr(metrics_sql()).alias("_m")).select("doc_id", "_m.*")
    per_word = lambda c: F.when(F.col("n_words") > 0, F.col(c) / F.col("n_words")).otherwise(F.lit(0.0))
    return df.select("*", per_word("word_chars").alias("mean_word_chars"), per_word("n_symbols").alias("symbol_ratio"), per_word("n_stop").alias("stop_ratio"), per_word("n_repeat_words").alias("repeat_ratio"), (F.col("n_dup_lines") / F.col("n_lines")).alias("dup_line_ratio"))


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """measured() with base_failed, kept and the names of the failed rules."""
    kept, names = verdict(rules)
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return measured(docs, id_col, text_col).select("*", base.alias("base_failed"), (~base & kept).alias("kept"), names.alias("failed_rules"))
