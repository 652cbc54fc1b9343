"""Line-first quality rules: judge every line, drop the lines that fail, reject documents that lose too much text.

All built-in expressions over arrays of one row; nothing is shuffled. Defined cases: null text is an empty one (no
words, base_failed); a text of any length is judged whole; rows are judged one by one, so ties and repeats do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "\\x20\\x09-\\x0D"
# Phrases and marks of page furniture.
BOILERPLATE = "(?i)(all rights reserved|terms of (use|service)|privacy policy|cookie|click here|subscribe (now|to)|sign up|log ?in|share this|read more|enable javascript|licensed under|copyright|©)"
NAVIGATION = "( [|»›·•>] [^|»›·•>]*){3}"


def words(text: Column) -> Column:
    """The words of a text; no word gives an empty array, null the same."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"[{SPACE}]+"))


def with_repeat_words(rows: DataFrame, word: str, size: int = 8) -> DataFrame:
    """rows with n_repeat_words: words inside windows of `size` words that the row holds twice or more, first included.

    Each array is a column of its own: a lambda that reached into an expression would compute it again per element.
    Rows whose windows all differ stop at the first comparison.
    """
    n = F.size(word)
    hashes = F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(word, i, size)))
    rows = rows.withColumn("_hashes", F.when(n >= size, hashes).otherwise(F.array().cast("array<bigint>")))
    pairs = F.array_sort(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("_pairs", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), pairs).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    at = lambda k: F.get("_pairs", k)["h"]
    twice = F.transform("_pairs", lambda p, k: F.when(p["h"].eqNullSafe(at(k - 1)) | p["h"].eqNullSafe(at(k + 1)), p["i"]))
    rows = rows.withColumn("_starts", F.array_sort(F.array_compact(twice)))
    gaps = F.transform("_starts", lambda s, k: F.least(F.lit(size), F.coalesce(F.get("_starts", k + 1) - s, F.lit(size))))
    return rows.withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0).cast("long"), lambda x, g: x + g)).drop("_hashes", "_pairs", "_starts")


def line_passes(line: Column) -> Column:
    """Punctuation, navigation and boilerplate rules for one line; blank lines pass, having nothing to lose."""
    bare = F.length(line)
    letters = F.length(F.regexp_replace(line, "[^\\p{L}\\p{N}\\s]+", ""))
    punctuation = (bare > 0) & (letters < 0.75 * bare)
    navigation = line.rlike(NAVIGATION)
    boilerplate = line.rlike(BOILERPLATE)
    return ~(punctuation | navigation | boilerplate)


def cleaned(docs: DataFrame, id: str = "doc_id", text: str = "text", lost: float = 0.5) -> DataFrame:
    """One row per document: the base counts, clean_text (passing lines), lost share, base_failed and kept."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id), body.alias("_text"), words(F.col(text)).alias("_words"), F.split(body, "\\n", -1).alias("_lines"))
    with_word = F.filter("_lines", lambda x: x.rlike(f"[^{SPACE}]"))
    rows = rows.select(
        id,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        with_word.alias("_full"),
        "_words",
        F.array_join(F.filter("_lines", line_passes), "\n").alias("clean_text"),
    )
    rows = with_repeat_words(rows, "_words").drop("_words")
    rows = rows.withColumn("n_dup_lines", (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long")).drop("_full")
    left = F.length(F.regexp_replace("clean_text", f"[{SPACE}]+", ""))
    rows = rows.withColumn("lost", F.when(F.col("word_chars") > 0, 1 - left / F.col("word_chars")).otherwise(F.lit(0.0)))
    rows = rows.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= lost))
