"""Line-first quality rules, in DataFrame functions only.

Every line with a word is judged by rules on its punctuation, on navigation and on boilerplate. Lines
that fail are removed, and a document that loses too much of its text is rejected. Figures on the
whole text (short texts, repeated words) reject a document whatever its lines are like.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywheel.llm.common import free_name, squeezed

_BLANK_CLASS = "\\x20\\x09-\\x0D"
SYMBOLS = "#*$%&|<>"
#: Phrases of page furniture (fixed values); a line of at most 20 words that holds one fails.
BOILERPLATE = ("all rights reserved", "cookie policy", "accept cookies", "privacy policy", "terms of service", "terms of use", "subscribe to our newsletter", "sign up for our newsletter", "click here", "read more", "enable javascript", "skip to content", "back to top", "share this", "follow us on", "lorem ipsum")
#: A line of at most 20 words; the match ends at the next word, however long the line is.
_FEW = f"^[{_BLANK_CLASS}]*+(?:[^{_BLANK_CLASS}]++[{_BLANK_CLASS}]*+){{0,20}}+$"
#: Words of menus (fixed values); a line of at most 10 words, half of them of this kind, fails.
MENU_WORDS = ("home", "menu", "login", "logout", "about", "contact", "search", "next", "previous", "sitemap", "faq", "help", "register", "share", "subscribe", "cart")


def _let(value: Column, body):
    """``body`` over a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{_BLANK_CLASS}]+"), lambda w: w != "")


def repeated_words(words: Column, window: int = 8) -> Column:
    """Number of words in windows of so many words that the text holds twice or more."""

    def covered(runs: Column) -> Column:
        pairs = F.array_sort(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def flagged(p: Column) -> Column:
            last = F.size(p) - 1
            own = F.transform(p, lambda x, i: F.when(((i > 0) & (F.get(p, i - 1)["h"] == x["h"])) | ((i < last) & (F.get(p, i + 1)["h"] == x["h"])), x["i"]))
            return F.array_sort(F.filter(own, lambda i: i.isNotNull()))

        def spread(f: Column) -> Column:
            gaps = F.transform(f, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(f, i + 1) - x, F.lit(window))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

        return _let(_let(pairs, flagged), spread)

    def count(w: Column) -> Column:
        runs = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))
        once = F.transform(w, lambda x: F.xxhash64(x))  # a window is hashed from its words' hashes
        return F.when(F.size(w) <= window, F.lit(0).cast("long")).otherwise(_let(_let(once, runs), lambda r: F.when(F.size(F.array_distinct(r)) == F.size(r), F.lit(0).cast("long")).otherwise(covered(r))))

    return _let(words, count)


def _fails(line: Column) -> Column:
    """Whether a line with a word breaks a rule."""
    dense = F.length(squeezed(line))
    symbols = dense - F.length(F.translate(squeezed(line), SYMBOLS, ""))
    low = F.lower(line)
    any_phrase = F.lit(False)
    for phrase in BOILERPLATE:
        any_phrase = any_phrase | F.contains(low, F.lit(phrase))
    menu = F.array(*[F.lit(w) for w in MENU_WORDS])

    def by_words(words: Column) -> Column:
        n = F.size(words)
        bare = F.transform(words, lambda w: F.lower(F.regexp_replace(w, "[^\\p{L}]+", "")))
        return any_phrase | ((n <= 10) & (2 * F.size(F.filter(bare, lambda w: F.array_contains(menu, w))) >= n))

    punctuation = 10 * symbols >= dense
    shouting = (dense >= 20) & ~F.rlike(line, F.lit("\\p{Ll}")) & F.rlike(line, F.lit("\\p{Lu}"))
    return F.when(punctuation | shouting, F.lit(True)).otherwise(F.when(F.rlike(line, F.lit(_FEW)), _let(words_of(line), by_words)).otherwise(F.lit(False)))


def quality_rules(docs: DataFrame, text_col: str = "text", min_kept: float = 0.5) -> DataFrame:
    """Every row of ``docs`` with its figures, verdicts and cleaned text.

    New columns: n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word
    that equal an earlier line), n_repeat_words (words in eight-word windows found twice or more),
    base_failed (fewer than 20 words, or over 30 % repeated), clean_text (lines that fail removed, the
    rest as it was), kept_share (share of word characters in it), kept (base passed and kept_share at
    least ``min_kept``). Columns of ``docs`` with these names are replaced, others pass through.

    Null texts count as empty: no words, base_failed, clean_text empty. Lines without a word are
    neither judged nor removed; one of any length is judged by its number of words. Equal rows get equal
    results; an empty table gives none.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    new = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "clean_text", "kept_share", "kept")
    has_word = lambda line: F.length(squeezed(line)) > 0
    lines, both = F.split(text, "\n"), free_name(docs, "words")
    worded = F.filter(lines, has_word)
    figures = docs.select(
        *[c for c in docs.columns if c not in new],
        _let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))).alias(both),
        F.length(squeezed(text)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(worded, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        F.array_join(F.filter(lines, lambda x: ~has_word(x) | ~_fails(x)), "\n").alias("clean_text"),
    )
    found = figures.withColumns({"n_words": F.col(both)["n_words"], "n_repeat_words": F.col(both)["n_repeat_words"]}).drop(both)
    found = found.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    found = found.withColumn("kept_share", F.when(F.col("word_chars") > 0, F.length(squeezed(F.col("clean_text"))) / F.col("word_chars")).otherwise(F.lit(0.0)))
    found = found.withColumn("kept", ~F.col("base_failed") & (F.col("kept_share") >= min_kept))
    return found.select(*[c for c in docs.columns if c not in new], *new)
