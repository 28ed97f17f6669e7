"""Quality rules by distribution divergence, with DataFrame functions only.

A document is compared to its language by two histograms: of the classes of its characters, and of
the common words of several languages (all further words are one cell more). The language's reference
follows the corpus: over all its documents of ``MIN_WORDS`` words or more, the median of each class's
share (which junk hardly moves) and the mean of each common word's.
The Jensen-Shannon distance (square root of the divergence to base 2, 0 to 1) must stay below a limit
for either histogram. Short texts have noisy histograms: the limits widen with ``1 / sqrt(n_words)``,
and a text under ``MIN_WORDS`` words isn't held against the references.

Counted besides: words, code points in words, symbols, lines equal to an earlier line, and words that
lie in a three-word window found twice or more. Windows are compared by a 64-bit hash of their words.

Everything happens within a row, but for the references of each language. Their number is checked before
they are broadcast; more than ``MAX_LANGUAGES`` are joined by shuffle.

A reference taken from the corpus itself is only as good as most of the language's documents: where more
than half of them are junk of one kind, that kind is the usual one.

Defined cases: a null text has no words and fails; a null language is a language of its own; repeated
rows are judged each, and of equal lines all but the first count; a very long text is one row's arrays, in
memory for one text; distances at a limit are kept; an empty table gives no rows; further columns stay as
they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.runtime import only, settle

MIN_WORDS = 50
CLASS_LIMIT, CLASS_NOISE = 0.16, 0.5
WORD_LIMIT, WORD_NOISE = 0.26, 0.7
MAX_LANGUAGES = 10_000

# Frequent function words of the four languages, and character classes.
COMMON_WORDS = sorted(
    set(
        "the of and to in is that it for as with was on be this are by from at an or not "
        "der die und das den von mit sich des auf ist im dem nicht ein eine als auch es aus "
        "le la les de et des un une du en que est pour qui dans par sur pas au avec "
        "el los las y que en un una del se por con no para su al lo como más es".split()
    )
)
CLASSES = {
    "upper": r"[^\p{Lu}]+",
    "letter": r"[^\p{L}]+",
    "digit": r"[^0-9]+",
    "stop": r"[^.,;:'\"!?()-]+",
    "symbol": r"[^#*$%&|<>]+",
}
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def profile(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the five counts and the two histograms as ``__class`` and ``__common``."""
    t = F.coalesce(F.col(text), F.lit(""))
    left = {k: F.length(F.regexp_replace(t, p, "")).cast("long") for k, p in CLASSES.items()}
    out = docs.withColumns({f"__{k}": v for k, v in left.items()} | {"__words": F.filter(F.split(t, f"{SPACE}+"), lambda w: w != ""), "__gap": F.length(F.regexp_replace(t, f"{WORD}+", "")), "__lines": F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))})
    out = out.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": (F.length(t) - F.col("__gap")).cast("long"),
            "n_symbols": F.col("__symbol"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__windows": F.expr("IF(size(__words) < 3, array(), transform(sequence(0, size(__words) - 3), i -> xxhash64(__words[i], __words[i + 1], __words[i + 2])))"),
            "__found": F.filter("__words", lambda w: w.isin(COMMON_WORDS)),
        }
    )
    out = out.withColumn("__sorted", F.expr("IF(size(array_distinct(__windows)) = size(__windows), array(), array_sort(transform(__windows, (h, i) -> struct(h, i))))"))
    out = out.withColumn("__twice", F.expr("array_sort(transform(filter(__sorted, (e, j) -> e.h <=> get(__sorted, j - 1).h OR e.h <=> get(__sorted, j + 1).h), e -> e.i))"))
    counts = ", ".join(f"size(__found) - size(array_remove(__found, '{w}'))" for w in COMMON_WORDS)
    out = out.withColumns(
        {
            "n_repeat_words": F.expr("aggregate(transform(__twice, (x, j) -> least(3, coalesce(get(__twice, j + 1) - x, 3))), 0L, (a, b) -> a + b)"),
            "__class": F.expr("transform(array(__upper, __letter - __upper, __digit, __stop, __symbol, word_chars - __letter - __digit - __stop - __symbol), x -> x / greatest(word_chars, 1))"),
            "__common": F.expr(f"transform(array({counts}, size(__words) - size(__found)), x -> x / greatest(n_words, 1))"),
        }
    )
    return out.select(*docs.columns, *COUNTS, "__class", "__common")


def distance(p: str, q: str):
    """Jensen-Shannon distance of two arrays that add up to 1 each; null if either is null."""
    part = f"aggregate(zip_with({p}, {q}, (a, b) -> IF(a > 0, a * log2(2 * a / (a + b)), 0D) + IF(b > 0, b * log2(2 * b / (a + b)), 0D)), 0D, (x, y) -> x + y)"
    return F.expr(f"sqrt(greatest({part} / 2, 0D))")


def references(profiled: DataFrame, language: str = "lang") -> DataFrame:
    """(__lang, __ref_class, __ref_common): the usual histograms of each language."""
    n, m = len(CLASSES) + 1, len(COMMON_WORDS) + 1
    usual = [F.percentile_approx(F.col("__class")[i], 0.5, 1000).alias(f"class_{i}") for i in range(n)]
    means = [F.avg(F.col("__common")[i]).alias(f"common_{i}") for i in range(m)]
    out = profiled.filter(F.col("n_words") >= MIN_WORDS).groupBy(F.col(language).alias("__lang")).agg(*usual, *means)
    out = out.select("__lang", F.array(*(f"class_{i}" for i in range(n))).alias("c"), F.array(*(f"common_{i}" for i in range(m))).alias("__ref_common"))
    return out.select("__lang", F.expr("transform(c, x -> x / aggregate(c, 0D, (a, b) -> a + b))").alias("__ref_class"), "__ref_common")


def judge(profiled: DataFrame, language: str = "lang") -> DataFrame:
    """Adds base_failed, class_distance, word_distance and kept; drops the histograms."""
    known = settle(references(profiled, language), "languages")
    near = F.broadcast(known) if known.count() <= MAX_LANGUAGES else known
    met = profiled.join(near, F.col(language).eqNullSafe(F.col("__lang")), "left")
    unsure = 1 / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    met = met.withColumns(
        {
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
            "class_distance": distance("__class", "__ref_class"),
            "word_distance": distance("__common", "__ref_common"),
        }
    )
    far = (F.col("class_distance") > CLASS_LIMIT + CLASS_NOISE * unsure) | (F.col("word_distance") > WORD_LIMIT + WORD_NOISE * unsure)
    met = met.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far & (F.col("n_words") >= MIN_WORDS), F.lit(False)))
    return met.drop("__lang", "__ref_class", "__ref_common", "__class", "__common")


def quality(docs: DataFrame, text: str = "text", language: str = "lang") -> DataFrame:
    """Every row of ``docs`` with its counts, distances and verdict."""
    return judge(settle(profile(docs, text), "profiles"), language)


def quality_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang") -> DataFrame:
    """As ``quality``, for the key alone: texts aren't written to the shared folder."""
    light = settle(profile(only(docs, key, language, text), text).drop(text), "profiles")
    return judge(light, language).drop(language)


