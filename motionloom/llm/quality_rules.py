"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Every rule names a ratio over the counts of one text and the range it must lie in.  The counts
are SQL expressions over arrays of the text's own words and lines, so a row never leaves its
task and nothing is shuffled.  Stop words count in either case.  Repeated 3-word windows are found
by sorting the text's window hashes (64 bits: in a text of a million words two differing windows share
one with probability 3e-8) together with their places; texts whose windows all differ skip the sort.

Null, empty and blank texts have zero counts and fail the base rule.  Texts of one very long
word, or of very many words, go the same way.  Rows without an id keep a null id; repeated rows get equal results.  Intermediate
columns carry a reserved prefix, so columns of the input cannot clash with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TMP, text_of

#: Frequent function words of the corpus languages.
STOP_WORDS = {
    "en": "the be to of and a in that have it for not on with he as you do at this but his by from is are was an or".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec".split(),
}

#: rule, ratio over the counts below, least, most (None: open).  A text is kept if all hold.
THRESHOLDS: list[tuple[str, str, float | None, float | None]] = [
    ("few_words", "n_words", 50, None),
    ("repeated_windows", "n_repeat_words / n_words", None, 0.5),
    ("word_length", "word_chars / n_words", 2.0, 12.0),
    ("symbols_per_word", "n_symbols / n_words", None, 0.25),
    ("stop_words_per_word", "n_stop_words / n_words", 0.06, None),
    ("duplicate_lines", "n_dup_lines / n_lines", None, 0.5),
    ("marked_line_ends", "n_ellipsis_lines / n_lines", None, 0.5),
]

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines", "n_ellipsis_lines"]
_SPACE = r"[\\x20\\x09-\\x0D]+"


def _count_columns(docs: DataFrame, text_col: str) -> DataFrame:
    """Add every count as a column with the reserved prefix."""
    t = TMP
    stops = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))
    df = docs.withColumn(f"{t}text", text_of(text_col))
    df = df.withColumn(f"{t}words", F.expr(f"filter(split({t}text, '{_SPACE}'), w -> w <> '')"))
    df = df.withColumn(f"{t}lines", F.expr(f"filter(split({t}text, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')"))
    windows = f"slice(transform({t}words, (w, i) -> named_struct('h', xxhash64(w, get({t}words, i + 1), get({t}words, i + 2)), 'i', i)), 1, greatest(size({t}words) - 2, 0))"
    df = df.withColumn(f"{t}windows", F.expr(windows))
    df = df.withColumn(
        f"{t}sorted",
        F.expr(f"if(size(array_distinct({t}windows.h)) = size({t}windows), cast(array() AS array<struct<h:bigint,i:int>>), sort_array({t}windows))"),
    )
    again = f"filter({t}sorted, (x, k) -> x.h = get({t}sorted, k - 1).h OR x.h = get({t}sorted, k + 1).h).i"
    df = df.withColumn(f"{t}again", F.expr(f"sort_array({again})"))
    counts = {
        "n_words": f"cast(size({t}words) AS bigint)",
        "word_chars": f"aggregate({t}words, 0L, (n, w) -> n + char_length(w))",
        "n_symbols": f"cast(char_length({t}text) - char_length(regexp_replace({t}text, '[#*$%&|<>]', '')) AS bigint)",
        "n_dup_lines": f"cast(size({t}lines) - size(array_distinct({t}lines)) AS bigint)",
        "n_repeat_words": f"aggregate({t}again, named_struct('last', -3, 'n', 0L), (a, x) -> named_struct('last', x, 'n', a.n + least(3, x - a.last)), a -> a.n)",
        "n_stop_words": f"cast(size(filter({t}words, w -> lower(w) IN ({stops}))) AS bigint)",
        "n_lines": f"cast(size({t}lines) AS bigint)",
        "n_ellipsis_lines": f"cast(size(filter({t}lines, l -> endswith(l, '...') OR endswith(l, '…'))) AS bigint)",
    }
    return df.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.expr(e).alias(f"{t}{n}") for n, e in counts.items()])


def compile_rules(thresholds: list[tuple[str, str, float | None, float | None]] = THRESHOLDS) -> dict[str, str]:
    """SQL of each rule over the count columns: true where the text passes (0/0 passes no lower bound)."""
    rules = {}
    for name, ratio, least, most in thresholds:
        sql = ratio
        for c in sorted(COUNTS, key=len, reverse=True):
            sql = sql.replace(c, f"{TMP}{c}") if f"{TMP}{c}" not in sql else sql
        top, _, bottom = sql.partition(" / ")
        value = f"({top} / nullif({bottom}, 0))" if bottom else f"({top})"
        tests = [f"{value} >= {least}D"] * (least is not None) + [f"{value} <= {most}D"] * (most is not None)
        rules[name] = f"coalesce({' AND '.join(tests)}, {'false' if least is not None else 'true'})"
    return rules


def quality_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, all counts, base_failed, kept, and the names of the rules that failed."""
    rows = _count_columns(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), "text")
    rules = compile_rules()
    failed = ", ".join(f"if({sql}, null, '{name}')" for name, sql in rules.items())
    base = f"({TMP}n_words < 50 OR 100 * {TMP}n_repeat_words > 50 * {TMP}n_words)"
    return rows.select(
        "doc_id",
        *[F.col(f"{TMP}{c}").alias(c) for c in COUNTS],
        F.expr(base).alias("base_failed"),
        F.expr(f"NOT {base} AND {' AND '.join(rules.values())}").alias("kept"),
        F.expr(f"array_compact(array({failed}))").alias("failed_rules"),
    )


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they were, whose text passes every rule."""
    rows = _count_columns(docs, text_col)
    base = f"NOT ({TMP}n_words < 50 OR 100 * {TMP}n_repeat_words > 50 * {TMP}n_words)"
    own = [F.col(f"`{c}`") for c in docs.columns]
    # A filter may not be pushed below a column that is not deterministic: otherwise the optimizer
    # puts every count's expression into the predicate, again and again, at each level of arrays.
    marked = rows.select(*own, F.expr(" AND ".join([base, *compile_rules().values()])).alias(f"{TMP}kept"), F.monotonically_increasing_id().alias(f"{TMP}row"))
    return marked.where(f"{TMP}kept AND {TMP}row >= 0").select(*own)
