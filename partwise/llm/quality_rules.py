"""Line-first quality rules, with DataFrame functions only.

Every line is judged first; lines that fail are removed, and a document that loses too much of its text is rejected.
A line with a word fails if one of these holds for its words [^\\x20\\x09-\\x0D]+ (characters are code points):

* punctuation: more than SYMBOL_PERCENT of its word characters are symbols #*$%&|<>, or it has more than one "!!" for
  every four words;
* navigation: at least NAV_BARS separators (SEPARATORS) and no more than four words for each;
* boilerplate: it has one of BOILERPLATE (in four languages), in either case, at the beginning of a word;
* ending: it breaks off with an ellipsis after at most TEASER words, as teasers do. Lines that just lack a full stop are
  left alone: headings, list items and verse do.

A document is kept if it passes the base rules (at least MIN_WORDS words; at most half of its words in repeated 3-word
windows) and the failed lines have at most LOST_PERCENT of its words.

All of it is one projection over the text: no shuffle, and memory follows the longest text.

Defined cases: null or empty text: no words, base_failed, not kept, cleaned text empty. Repeated rows each get their row.
Other columns pass through filter_documents() and are ignored by quality_rules().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]+"
MIN_WORDS, REPEAT_PERCENT = 50, 50
INDEX_BITS = 21
SYMBOL_PERCENT, NAV_BARS, LOST_PERCENT, TEASER = 10, 3, 50, 12
SEPARATORS = "[|·•»›→]"
ELLIPSIS = r"(\.\.\.|…)[\x20\x09-\x0D]*$"
# Phrases of lines that are not part of an article.
BOILERPLATE = (
    "all rights reserved",
    "licensed under",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "accept cookies",
    "enable javascript",
    "subscribe to our newsletter",
    "click here",
    "share this",
    "log in to",
    "sign up for",
    "lorem ipsum",
    "alle rechte vorbehalten",
    "datenschutzerkl",
    "nutzungsbedingungen",
    "cookies akzeptieren",
    "newsletter abonnieren",
    "hier klicken",
    "tous droits r",
    "accepter les cookies",
    "cliquez ici",
    "todos los derechos reservados",
    "aceptar cookies",
    "haga clic aqu",
)
PHRASES = "(?i)(?:^|[^A-Za-z])(?:" + "|".join(BOILERPLATE) + ")"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def _then(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns as a step of its own: the row id keeps Spark from merging it with the next or filtering beneath it,
    either of which would compute an array once for each of its elements."""
    return df.withColumns(columns | {"__row_id": F.monotonically_increasing_id() + 0 * F.col("__row_id")})


def _with_repeats(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: the words of the 3-word windows found twice or more.

    A window is one long: the upper bits of its hash, and where it starts in the lower INDEX_BITS. These sort fast; equal
    upper bits stand side by side. Where neighbours have equal upper bits but other hashes (or a text is too long for the
    index), the exact but slower way over whole hashes is taken.
    """
    low = (1 << INDEX_BITS) - 1
    w, n = F.col("__words"), F.size("__words")
    no_longs = F.array().cast("array<bigint>")
    hashed = lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2])
    at = F.sequence(F.lit(0), n - 3)
    packed = F.transform(at, lambda i: hashed(i).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))
    df = _then(df, __windows=F.when((n >= 6) & (n <= low), F.sort_array(packed)).otherwise(no_longs))
    upper = lambda x: F.shiftright(x, INDEX_BITS)
    s = F.col("__windows")
    df = _then(df, __twice=F.filter(s, lambda x, k: (upper(x) == upper(F.get(s, k - 1))) | (upper(x) == upper(F.get(s, k + 1)))))
    t = F.col("__twice")
    place = lambda x: x.bitwiseAND(F.lit(low)).cast("int")
    differ = lambda x, k: (k > 0) & (upper(x) == upper(F.get(t, k - 1))) & (hashed(place(x)) != hashed(place(F.get(t, k - 1))))
    df = _then(df, __slow=(n > low) | (F.size(F.filter(t, differ)) > 0))
    whole = F.sort_array(F.transform(at, lambda i: F.struct(hashed(i).alias("h"), i.alias("i"))))
    df = _then(df, __exact=F.when(F.col("__slow"), whole).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    e = F.col("__exact")
    same = F.filter(e, lambda x, k: (x["h"] == F.get(e, k - 1)["h"]) | (x["h"] == F.get(e, k + 1)["h"]))
    df = _then(df, __starts=F.sort_array(F.when(F.col("__slow"), F.transform(same, lambda x: x["i"])).otherwise(F.transform(t, place))))
    i, size = F.col("__starts"), F.size("__starts")
    steps = F.zip_with(F.slice(i, 1, size - 1), F.slice(i, 2, size - 1), lambda a, b: F.least(b - a, F.lit(3)))
    covered = F.when(size == 0, F.lit(0)).otherwise(F.aggregate(steps, F.lit(3), lambda total, x: total + x))
    return _then(df, n_repeat_words=F.when(n < 6, _few(w)).otherwise(covered).cast("long"))


def _few(w: Column) -> Column:
    """n_repeat_words of up to five words: the windows 0, 1 and 2."""
    same = lambda a, b: (w[a] == w[b]) & (w[a + 1] == w[b + 1]) & (w[a + 2] == w[b + 2])
    n = F.size(w)
    a = (n >= 4) & F.coalesce(same(0, 1), F.lit(False))
    b = (n >= 5) & F.coalesce(same(1, 2), F.lit(False))
    c = (n >= 5) & F.coalesce(same(0, 2), F.lit(False))
    return F.when(c | (a & b), F.lit(5)).when(a | b, F.lit(4)).otherwise(F.lit(0))


def _line_fails(line: Column) -> Column:
    solid = F.length(F.regexp_replace(line, BLANKS, ""))
    symbols = F.length(F.regexp_replace(line, "[^#*$%&|<>]+", ""))
    gaps = F.size(F.split(F.trim(line), BLANKS))
    bangs = F.size(F.split(line, "!!")) - 1
    bars = F.size(F.split(line, SEPARATORS)) - 1
    return (
        (symbols * 100 > solid * SYMBOL_PERCENT)
        | (bangs * 4 > gaps)
        | ((bars >= NAV_BARS) & (gaps <= 4 * bars))
        | ((gaps <= TEASER) & line.rlike(ELLIPSIS))
        | line.rlike(PHRASES)
    )


def _judged(documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    worded = lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    lines = F.filter(F.split(text, "\n"), worded)
    df = _then(documents.withColumn("__row_id", F.lit(0).cast("long")), __words=_words(text), __lines=lines)
    df = _then(
        df,
        n_words=F.size("__words").cast("long"),
        word_chars=F.length(F.array_join("__words", "")).cast("long"),
        n_symbols=F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long"),
        n_dup_lines=(F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        __kept=F.filter(F.split(text, "\n"), lambda x: ~(worded(x) & _line_fails(x))),
    )
    df = _with_repeats(df)
    df = _then(
        df,
        __kept_words=F.size(_words(F.array_join("__kept", "\n"))).cast("long"),
        base_failed=(F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")),
    )
    lost = F.col("n_words") - F.col("__kept_words")
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("__row_id") >= 0) & (100 * lost <= LOST_PERCENT * F.col("n_words")))


def quality_rules(documents: DataFrame) -> DataFrame:
    """For each document its counts, base_failed, kept, and kept_words: the words of the lines that pass."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return _judged(documents.select("doc_id", "text")).select("doc_id", *names, F.col("__kept_words").alias("kept_words"))


def filter_documents(documents: DataFrame, clean: bool = False) -> DataFrame:
    """The kept documents with all their columns; clean: without their failed lines (and n_chars, if there, to match)."""
    columns = documents.columns
    slim = documents.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("__row"), F.col("text"))
    df = _judged(slim).where("kept").select("__row", F.array_join("__kept", "\n").alias("__clean"))
    new = {"text": F.col("__clean"), "n_chars": F.length("__clean").cast(documents.schema["n_chars"].dataType)} if clean and "n_chars" in columns else {"text": F.col("__clean")} if clean else {}
    return df.select(*(new.get(c, F.col("__row")[c]).alias(c) for c in columns))
