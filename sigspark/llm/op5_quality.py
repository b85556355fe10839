"""Quality rules: base counts, then the divergence of a document's histograms from its language's references.

References are gathered from all documents of a language: how its code points fall into character classes, and how its
words fall on the language's most frequent function words (one further bin holds all other words). A document is
rejected when the Jensen-Shannon distance (base 2, square root of the divergence, 0 to 1) of either histogram exceeds its
threshold. Short texts are guarded twice: each comparison applies from a minimum length on, and the threshold for words
rises by what chance alone adds to a sample of that length. A language without references is compared on neither.

Only DataFrame functions are used; all counts are taken inside the row. Defined results: null or empty text has no
words and fails the base rule; null or unknown lang: base rule only, plus the character classes where a reference
exists; repeated rows are each answered; an empty table gives no rows; extra columns are ignored; texts of any length
are read whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, bound, text_of, written

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: What ends a word when it is looked up among common ones.
EDGE = r"[\x20\x09-\x0D.,;:!?'\"()]+"
SYMBOLS = "#*$%&|<>"
#: Character classes besides lower-case letters, each as what is left out of the text to count it; the rest is the last class.
LOWER_CASE = r"\p{Ll}+"
CLASSES = {"upper": r"\p{Lu}+", "digit": r"\p{Nd}+", "space": r"\s+", "stop": r"[.,;:!?'\"()\-]+", "symbol": r"[#*$%&|<>@_=+/\\^~{}\[\]]+"}
#: Frequent function words, one list per language; a parameter of the operator.
COMMON = {
    "en": "the of and to a in is that it for was on with as be by this are at from".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au pas avec".split(),
    "de": "der die und in den von zu das mit sich des für auf ist im nicht dem ein eine als".split(),
    "es": "de la que el en y los se del un las por con no una su para es al lo".split(),
}


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, GAP), lambda w: w != "")


WIDTH = 5


def repeated_words(words: Column) -> Column:
    """Words in windows of five words that the text holds at least twice, the first occurrence included."""

    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - WIDTH), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WIDTH)]))

    def covered(hits: Column) -> Column:
        gaps = F.transform(hits, lambda at, k: F.least(F.lit(WIDTH), F.coalesce(F.get(hits, k + 1) - at, F.lit(WIDTH))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def hits(ordered: Column) -> Column:
        again = lambda x, k: (F.get(ordered, k + 1)["h"] == x["h"]) | ((k > 0) & (F.get(ordered, F.greatest(k - 1, F.lit(0)))["h"] == x["h"]))
        return F.array_sort(F.transform(F.filter(ordered, lambda x, k: F.coalesce(again(x, k), F.lit(False))), lambda x: x["at"]))

    def from_windows(w: Column) -> Column:
        ordered = F.sort_array(F.transform(w, lambda h, at: F.struct(h.alias("h"), at.alias("at"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(bound(bound(ordered, hits), covered))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    some = bound(hashes, lambda h: bound(windows(h), from_windows))
    return F.when(F.size(words) <= WIDTH, F.lit(0)).otherwise(some).cast("long")


def character_counts(text: Column) -> Column:
    """A struct: code points by class (the last class is what the others leave), n_chars, word_chars and n_symbols.
    Lower-case letters go first, so that the other counts read a short rest."""

    def count(rest: Column) -> Column:
        gone = lambda pattern: (F.length(rest) - F.length(F.regexp_replace(rest, pattern, ""))).cast("long")
        lower = (F.length(text) - F.length(rest)).cast("long")
        symbols = F.regexp_count(rest, F.lit("[" + SYMBOLS.replace("|", r"\|").replace("&", r"\&") + "]")).cast("long")
        n = F.length(text).cast("long")
        return F.struct(F.array(lower, *map(gone, CLASSES.values())).alias("classes"), n.alias("n_chars"), (n - gone(GAP)).alias("word_chars"), symbols.alias("n_symbols"))

    return bound(F.regexp_replace(text, LOWER_CASE, ""), count)


def measured(docs: DataFrame, common: dict[str, list[str]]) -> DataFrame:
    """Counts of each row: doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes, n_chars, common."""
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), text_of().alias("text"))
    listed = F.lit(None).cast("array<string>")
    for lang, own in common.items():
        listed = F.when(F.col("lang") == lang, F.array(*map(F.lit, own))).otherwise(listed)
    every = sorted({w for own in common.values() for w in own})
    rows = rows.withColumn("words", words_of(F.col("text"))).withColumn("ch", character_counts(F.col("text")))
    found = F.filter(F.split(ascii_lower(F.col("text")), EDGE), lambda w: w.isin(every))

    def on_list(found: Column) -> Column:
        return F.transform(listed, lambda w: F.size(F.filter(found, lambda x: x == w)).cast("long"))

    lines = F.filter(F.split(F.col("text"), "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0)
    return rows.select(
        "doc_id", "lang", F.size("words").cast("long").alias("n_words"), "ch.word_chars", "ch.n_symbols",
        bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"), "ch.classes", "ch.n_chars",
        bound(found, on_list).alias("common"),
    )


def with_rest(counts: Column, total: Column) -> Column:
    return F.concat(counts, F.array(F.greatest(total - F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))))


def references(rows: DataFrame, common: dict[str, list[str]]) -> DataFrame:
    """(lang, ref_classes, ref_common): shares over all documents of each language of `common`; at most one row a language."""
    k, m = len(CLASSES) + 2, max(map(len, common.values())) + 1
    known = rows.where(F.col("lang").isin(list(common)))
    sums = [F.sum(F.coalesce(F.get("c", F.lit(i)), F.lit(0))).alias(f"c{i}") for i in range(k)] + [F.sum(F.coalesce(F.get("w", F.lit(i)), F.lit(0))).alias(f"w{i}") for i in range(m)]
    totals = known.select("lang", with_rest(F.col("classes"), F.col("n_chars")).alias("c"), with_rest(F.col("common"), F.col("n_words")).alias("w")).groupBy("lang").agg(*sums)
    return totals.select("lang", F.array(*[F.col(f"c{i}") for i in range(k)]).alias("ref_classes"), F.array(*[F.col(f"w{i}") for i in range(m)]).alias("ref_common"))


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the base-2 Jensen-Shannon divergence of two count arrays; null where either is empty."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def shares(a: Column) -> Column:
        return bound(total(a), lambda t: F.transform(a, lambda x: F.when(t > 0, x / t)))

    def half(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))

    def of(pair: Column) -> Column:
        terms = F.zip_with(pair["p"], pair["q"], lambda x, y: half(F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0))) + half(F.coalesce(y, F.lit(0.0)), F.coalesce(x, F.lit(0.0))))
        return F.sqrt(F.greatest(F.lit(0.0), total(terms) / 2))

    usable = (total(p) > 0) & (total(q) > 0)
    return F.when(usable, bound(F.struct(shares(p).alias("p"), shares(q).alias("q")), of))


def quality(docs: DataFrame, max_class_distance: float = 0.3, max_common_distance: float = 0.2, min_chars: int = 200, min_words: int = 40, common: dict[str, list[str]] | None = None) -> DataFrame:
    """Base counts, distances and the verdict `kept` for every row of docs (doc_id, text, lang)."""
    common = common or COMMON
    rows = written(measured(docs, common), "measured")
    refs = F.broadcast(references(rows, common))  # at most one row for each language of the parameter
    out = rows.join(refs, "lang", "left")
    out = out.withColumn("class_distance", F.when(F.col("n_chars") >= min_chars, js_distance(with_rest(F.col("classes"), F.col("n_chars")), F.col("ref_classes"))))
    out = out.withColumn("common_distance", F.when(F.col("n_words") >= min_words, js_distance(with_rest(F.col("common"), F.col("n_words")), F.col("ref_common"))))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    # Chance adds about (bins - 1) / (8 n ln 2) to the divergence of n words.
    bins = F.size("ref_common")
    chance = 1.25 * (bins - 1) / (8 * math.log(2) * F.greatest(F.col("n_words"), F.lit(1)))
    limit = F.sqrt(F.lit(max_common_distance**2) + chance)
    far = (F.coalesce(F.col("class_distance"), F.lit(0.0)) > max_class_distance) | F.coalesce(F.col("common_distance") > limit, F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~far).alias("kept"), "class_distance", "common_distance")
