"""Quality rules with thresholds that adapt to each language and source.

Every document is measured; per (lang, source) a mergeable quantile sketch of
each measure is built. The fence of a measure is its upper (lower) quartile plus
(minus) SPREADS times the quartile spread of the group; no fixed cutoff stands in
for it. The quartiles of a group of n documents are drawn toward those of its
language with weight PRIOR / (n + PRIOR), and those toward all documents alike, so
small groups borrow smoothly. Counts (symbols, repeated lines, repeated words,
characters in words) are held against the fence of their share with an allowance
for chance: a count fails beyond
share * size + NOISE * sqrt(unit * share * size) + NOISE**2 * unit,
so that where a group's quartiles are zero a single repeated line is no reason.
Fixed base rules (too few words, too much repetition) apply first.

Only DataFrame functions run here. The sketches are partial aggregates, so a hot
source costs one sketch per map task; the threshold table has one row per (lang,
source) and is broadcast only after its rows are counted, else hot groups are
dealt over several tasks. The filter reads its own measured table: no join
carries texts.

Defined results: a null text has no words and fails; null lang or source form a
group of their own, as does a missing column; an empty table gives an empty
result; further columns are ignored by the measures, whatever their names, and
kept by the filter; rows that repeat are judged each; doc_id may be null; ties at
a fence pass.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import BROADCAST_ROWS, materialize, read_table, release, spread_join, unused_name

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Base rules: fewest words, most repeated words in 100, words of a window.
MIN_WORDS, MAX_REPEATS, WINDOW = 20, 30, 8
#: Documents that the quartiles of the language count for in those of a group.
PRIOR = 200
#: Quartile spreads beyond the quartile at which a document fails, allowance for chance, sketch size.
SPREADS, NOISE, SKETCH_K = 5.0, 3.0, 400
#: Least quartile spread of the word length, as a share of it: copies of one text may fill both quartiles.
LEAST_SPREAD = 0.05
#: Counts: what they are a share of, and the least that one occurrence adds (a repeated window is two windows).
COUNTS = {"n_symbols": ("n_words", 1), "n_dup_lines": ("n_lines", 1), "n_repeat_words": ("n_words", 2 * WINDOW)}
MEASURES = ("n_words", "n_lines", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def measures(text: Column, window: int = WINDOW) -> Column:
    """A struct of MEASURES (long) of a text that is not null.

    Windows are compared by a 64-bit key first; only texts in which a key comes
    twice have their windows compared word for word.
    """
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, SPACE, "") != "")
    words = let(words_of(text), lambda w: F.struct(F.size(w).alias("n"), _repeats(w, window).alias("repeats")))
    copies = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("copies")))
    symbols = F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))
    return let(
        F.struct(words.alias("w"), copies.alias("x"), F.char_length(F.translate(text, SPACE, "")).alias("c"), symbols.alias("s")),
        lambda m: F.struct(*(v.cast("long").alias(k) for k, v in zip(MEASURES, (m["w"]["n"], m["x"]["n"], m["c"], m["s"], m["x"]["copies"], m["w"]["repeats"])))),
    )


def measure(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, str]:
    """``docs`` with one more column, and its name: a struct of the group (grp), lang, source and MEASURES."""
    name = unused_name(docs, "_measured")
    groups = [(docs[c] if c in docs.columns else F.lit(None)).cast("string").alias(c) for c in ("lang", "source")]
    grp = F.to_json(F.struct(*groups)).alias("grp")  # leaves nulls out
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.withColumn(name, let(measures(text, window), lambda m: F.struct(grp, *groups, *(m[k].alias(k) for k in MEASURES)))), name


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, also where inner lambdas read it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeats(words: Column, window: int) -> Column:
    n = F.size(words)
    keys = F.transform(F.sequence(F.lit(1), n - (window - 1)), lambda i: F.xxhash64(F.slice(words, i, window)))
    some = let(keys, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0)).otherwise(_covered(words, k, window)))
    return F.when(n >= window, some).otherwise(F.lit(0))


def _covered(words: Column, keys: Column, window: int) -> Column:
    """Words covered by windows that come twice or more in the text.

    Window positions are sorted by (key, position); equal neighbours, compared
    by their words, are repeats. A sweep over their starts adds up what they cover.
    """
    same = lambda a, b: (a["k"] == b["k"]) & (F.slice(words, a["i"] + 1, window) == F.slice(words, b["i"] + 1, window))

    def sweep(pairs: Column) -> Column:
        n = F.size(pairs)
        before = lambda p, j: (j > 0) & same(p, F.element_at(pairs, F.greatest(j, F.lit(1))))
        after = lambda p, j: (j + 1 < n) & same(p, F.element_at(pairs, F.least(j + 2, n)))
        starts = F.array_sort(F.filter(F.transform(pairs, lambda p, j: F.when(before(p, j) | after(p, j), p["i"])), lambda i: i.isNotNull()))
        none = F.struct(F.lit(0).alias("end"), F.lit(0).alias("covered"))
        step = lambda s, i: F.struct((i + window).alias("end"), (s["covered"] + i + window - F.greatest(s["end"], i)).alias("covered"))
        return F.aggregate(starts, none, step, lambda s: s["covered"])

    return let(F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i")))), sweep)


def base_failed(at: str = "") -> Column:
    n = F.col(f"{at}n_words")
    return (n < MIN_WORDS) | (100 * F.col(f"{at}n_repeat_words") > MAX_REPEATS * n)


def shares() -> dict[str, Column]:
    """What is sketched: counts as shares, and the mean length of words."""
    whole = lambda of: F.greatest(F.col(of), F.lit(1))
    return {k: F.col(k) / whole(of) for k, (of, _) in COUNTS.items()} | {"word_length": F.col("word_chars") / whole("n_words")}


def thresholds(measured: DataFrame) -> DataFrame:
    """One row per group: grp, n (its documents), and for each sketched measure its fences (``_high``, ``_low``).

    Quantiles come from KLL sketches, merged from the map tasks; those of the
    language and of all documents from the merged sketches of their groups.
    """
    cols = shares()
    sketch = [F.kll_sketch_agg_double(F.when(~base_failed(), c).cast("double"), SKETCH_K).alias(m) for m, c in cols.items()]
    sketched = materialize(measured.groupBy("grp", "lang").agg(F.count_if(~base_failed()).alias("n"), F.count(F.lit(1)).alias("rows"), *sketch), "quality-sketches")
    some = sketched.filter("n > 0")
    merged = [F.kll_merge_agg_double(m, SKETCH_K).alias(m) for m in cols]
    quartiles = lambda frame, of: [F.kll_sketch_get_quantile_double(frame[m], F.lit(p)).alias(f"{of}_{m}_{q}") for m in cols for q, p in (("1", 0.25), ("3", 0.75))]
    whole = (F.col("rows") > 0).alias("_all")  # true of every group
    every = some.groupBy(whole).agg(*merged)  # one row, or none of an empty table
    every = every.select("_all", *quartiles(every, "all"))
    langs = some.groupBy(F.to_json(F.struct("lang")).alias("_lang")).agg(F.sum("n").alias("_lang_n"), *merged)
    langs = langs.select("_lang", "_lang_n", *quartiles(langs, "lang"))
    own = sketched.select("grp", whole, F.to_json(F.struct("lang")).alias("_lang"), "rows", "n", *(F.when(F.col("n") > 0, q).alias(a) for q, a in zip(quartiles(sketched, "own"), (f"own_{m}_{q}" for m in cols for q in "13"))))
    both = own.join(langs, "_lang", "left").join(F.broadcast(every), "_all", "left")
    drawn = lambda value, n, prior: F.when(F.coalesce(n, F.lit(0)) > 0, (value * n + PRIOR * prior) / (n + PRIOR)).otherwise(prior)
    at = lambda m, q: drawn(F.col(f"own_{m}_{q}"), F.col("n"), drawn(F.col(f"lang_{m}_{q}"), F.col("_lang_n"), F.col(f"all_{m}_{q}")))
    quarters = both.select("grp", "rows", *(at(m, q).alias(f"{m}_{q}") for m in cols for q in "13"))
    least = {"word_length": LEAST_SPREAD}
    spread = lambda m: SPREADS * F.greatest(F.col(f"{m}_3") - F.col(f"{m}_1"), least.get(m, 0.0) * F.col(f"{m}_3"))
    out = quarters.select("grp", "rows", *((F.col(f"{m}_3") + spread(m)).alias(f"{m}_high") for m in cols), *((F.col(f"{m}_1") - spread(m)).alias(f"{m}_low") for m in cols))
    limits = materialize(out, "quality-thresholds")  # one row per (lang, source)
    release(sketched)
    return limits


def odd() -> Column:
    """Whether a document lies beyond a fence of its group; false where there is none, as with base failures alone."""
    tests = []
    for k, (of, unit) in COUNTS.items():
        usual = F.greatest(F.col(f"{k}_high"), F.lit(0.0)) * F.col(of)
        tests.append(F.col(k) > usual + NOISE * F.sqrt(unit * usual) + NOISE**2 * unit)
    for name, sign in (("word_length_high", 1), ("word_length_low", -1)):
        usual = F.greatest(F.col(name), F.lit(0.0)) * F.col("n_words")
        tests.append(sign * (F.col("word_chars") - usual) > NOISE * F.sqrt(usual) + NOISE**2)
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """``measured`` (grp, MEASURES and more) with base_failed and kept."""
    if limits.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        joined = measured.join(F.broadcast(limits.drop("rows")), "grp", "left")
    else:
        total = limits.agg(F.sum("rows")).first()[0]
        joined = spread_join(measured, limits, ["grp"], F.monotonically_increasing_id(), "rows", total)
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~odd())


def quality(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the measures, base_failed and kept."""
    of, name = measure(docs.select("doc_id", "text", *(c for c in ("lang", "source") if c in docs.columns)))
    measured = materialize(of.select("doc_id", f"{name}.*"), "quality-measures")
    return judge(measured, thresholds(measured)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns; those that don't are out, also all of a table without a good one."""
    of, name = measure(docs)
    measured = materialize(of, "quality-documents")  # texts with their measures: the filter is one more scan, no join of texts
    limits = thresholds(measured.select(f"{name}.*"))
    whole = unused_name(docs, "_row")
    flat = measured.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(whole), f"{name}.*")
    return judge(flat, limits).filter("kept").select(*(F.col(whole)[c].alias(c) for c in docs.columns))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read_table(spark, sf_dir, "documents"))
