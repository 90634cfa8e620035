r"""Quality rules, line first: bad lines are removed, then documents that lost too much are rejected.

DataFrame functions only. Words are runs of characters other than space, tab, LF, VT, FF and CR;
lines are split at LF. A line fails if

- punctuation: at least half of its words end in two or more of ``!?`` or in a symbol ``#*$%&<>``, or
  at least a fifth of the characters in its words are symbols ``#*$%&|<>``, or it has ten words or more
  and not one mark of a sentence such as ``.``, ``,`` or ``?``;
- navigation: at least a third of its words are separators such as ``|`` or ``>``, or two or more
  separators part it into entries of three words or fewer on average;
- boilerplate: phrases of ``BOILERPLATE``, in any case and each counted once, make up at least a tenth
  of its characters, so that a long sentence which mentions one stays;
- repetition: it has a word and equals an earlier line of the document, or it has four words or more
  and at least two thirds of them equal the word before.

A document is rejected if it has fewer than 20 words, if more than 30 % of its words lie in 8-word
windows found twice or more, or if the lines that failed, for whatever reason, hold more than
``MOST_LOST`` % of the characters in its words. So no document that is kept is left empty. The rules are
per row: repeated rows get equal verdicts, a null or empty text has no words and is rejected, an empty
table gives an empty result, other columns are carried along and may be null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_LOST = 40
WINDOW = 8
# Stock phrases of web pages, in lower case.
BOILERPLATE = (
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "use cookies",
    "enable javascript", "click here", "sign up for", "subscribe to our", "share this", "skip to content", "lorem ipsum",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "cookie-richtlinie", "verwenden cookies", "verwendet cookies",
    "javascript aktivieren", "klicken sie hier", "hier klicken", "newsletter abonnieren", "zum inhalt springen",
    "tous droits réservés", "politique de confidentialité", "conditions générales", "politique de cookies", "utilise des cookies", "utilisons des cookies",
    "activer javascript", "cliquez ici", "inscrivez-vous à", "abonnez-vous à", "partager cet article", "aller au contenu",
    "todos los derechos reservados", "política de privacidad", "condiciones de uso", "términos de uso", "términos de servicio", "política de cookies",
    "utiliza cookies", "utilizamos cookies", "usamos cookies", "habilite javascript", "haga clic aquí", "haz clic aquí", "suscríbete a", "suscríbase a", "saltar al contenido",
)

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
LOUD_END = r"(?:[!?]{2,}|[#*$%&<>])$"
SEPARATOR = r"^[|>»›·•/]+$"
MARK = r"[.,;:!?…。、！？，]"
UNMARKED = 10  # words of a line that needs a mark of a sentence
ENTRY = 3  # words of an entry of navigation, on average
STOCK_SHARE = 10  # percent of a line's characters that make it boilerplate
#: A text in which no line can fail for its symbols or as navigation does not match this.
SUSPECT = r"[!?]{2}|[#*$%&|<>»›·•/]"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def _solid(lines: Column) -> Column:
    """Characters in the words of an array of lines."""
    return F.length(F.array_join(F.flatten(F.transform(lines, _words)), ""))


def _stock(text: Column) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a | b, (low.contains(p) for p in BOILERPLATE))


def _stock_line(line: Column) -> Column:
    held = F.aggregate(F.array(*map(F.lit, BOILERPLATE)), F.lit(0), lambda n, p: n + F.when(F.lower(line).contains(p), F.length(p)).otherwise(0))
    return _stock(line) & (100 * held >= STOCK_SHARE * F.length(line))


def _bad_line(line: Column, words: Column) -> Column:
    loud = F.size(F.filter(words, lambda w: w.rlike(LOUD_END)))
    separators = F.size(F.filter(words, lambda w: w.rlike(SEPARATOR)))
    same = F.size(F.filter(words, lambda w, i: w.eqNullSafe(_beside(words, i, -1))))
    symbols, n = F.regexp_count(line, F.lit(SYMBOLS)), F.size(words)
    punctuation = (2 * loud >= n) | (5 * symbols >= F.length(F.array_join(words, ""))) | ((n >= UNMARKED) & ~line.rlike(MARK))
    navigation = (3 * separators >= n) | ((separators >= 2) & (n - separators <= ENTRY * (separators + 1)))
    return (n > 0) & (punctuation | navigation | ((n >= 4) & (3 * same >= 2 * n)))


def _beside(items: Column, i: Column, step: int) -> Column:
    return F.get(items, i + step)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars, base_failed, kept and clean_text (the lines that passed).

    Columns of these names that docs already has are replaced.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "base_failed", "kept", "clean_text"]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in names]).alias("row")
    df = docs.select(row, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    df = df.select("row", "t", _words(F.col("t")).alias("words"), F.split("t", "\n").alias("lines"), F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"))
    df = df.withColumns({
        "worded": F.filter("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "n_words": F.size("words").cast("long"),
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "hashes": F.transform("words", lambda w: F.xxhash64(w)),
    })
    df = df.withColumn("stutters", F.size(F.filter("hashes", lambda h, i: h.eqNullSafe(_beside(F.col("hashes"), i, -1)) & h.eqNullSafe(_beside(F.col("hashes"), i, -2)))))
    windows = F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - WINDOW), lambda i: F.xxhash64(*[F.get("hashes", i + j) for j in range(WINDOW)]))
    df = df.withColumns({"windows": F.when(F.col("n_words") >= WINDOW, windows), "n_dup_lines": (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long")}).drop("hashes", "worded", "words")
    # windows found twice: neighbours once all are sorted; then their places in order, each covering at most WINDOW words
    places = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("places", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), places)).drop("windows")
    twice = F.filter("places", lambda x, j: x.h.eqNullSafe(_beside(F.col("places"), j, -1).h) | x.h.eqNullSafe(_beside(F.col("places"), j, 1).h))
    df = df.withColumn("twice", F.sort_array(F.transform(twice, lambda x: x.i))).drop("places")
    covers = F.transform("twice", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(_beside(F.col("twice"), j, 1) - p, F.lit(WINDOW))))
    df = df.withColumn("n_repeat_words", F.coalesce(F.aggregate(covers, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")).drop("twice")
    # lines: repetition, then the rules on a line by itself
    numbered = F.sort_array(F.transform("lines", lambda x, i: F.struct(F.xxhash64(x).alias("h"), i.alias("i"), x.alias("x"))))
    df = df.withColumn("numbered", F.when(F.col("n_dup_lines") > 0, numbered))
    first = F.filter("numbered", lambda x, j: ~x.x.rlike(r"[^\x20\x09-\x0D]") | ~x.x.eqNullSafe(_beside(F.col("numbered"), j, -1).x))
    once = F.transform(F.sort_array(F.transform(first, lambda x: F.struct(x.i, x.x))), lambda x: x.x)
    df = df.withColumn("once", F.coalesce(once, F.col("lines"))).drop("numbered", "lines")
    # two thirds of a line's words can equal the word before only where three equal words follow each other
    unmarked = F.exists("once", lambda x: (F.length(x) >= 2 * UNMARKED - 1) & ~x.rlike(MARK))
    suspect = F.col("t").rlike(SUSPECT) | (F.col("stutters") > 0) | unmarked
    df = df.withColumn("split", F.when(suspect, F.transform("once", lambda x: F.struct(x.alias("x"), _words(x).alias("w")))))
    good = F.transform(F.filter("split", lambda y: ~_bad_line(y.x, y.w)), lambda y: y.x)
    df = df.withColumn("good", F.coalesce(good, F.col("once"))).drop("split")
    df = df.withColumn("fine", F.when(_stock(F.col("t")), F.filter("good", lambda x: ~_stock_line(x))).otherwise(F.col("good")))
    lost = (F.col("n_dup_lines") > 0) | (F.size("fine") < F.size("once"))
    df = df.withColumns({
        "lost_chars": F.when(lost, F.col("word_chars") - _solid(F.col("fine"))).otherwise(0).cast("long"),
        "clean_text": F.array_join("fine", "\n"),
        "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
    }).drop("once", "good", "fine", "t", "stutters")
    df = df.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= MOST_LOST * F.col("word_chars")))
    return df.select("row.*", *names)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the figures and verdict, and length and SHA-256 of the text that would be left."""
    measured = measure(docs.select("doc_id", "text"))
    return measured.withColumns({"clean_chars": F.length("clean_text").cast("long"), "clean_sha256": F.sha2("clean_text", 256)}).drop("text", "clean_text")


def clean(docs: DataFrame) -> DataFrame:
    """The documents that are not rejected, without the lines that failed; n_chars, if there, is set anew."""
    # an expression that is not deterministic keeps the optimiser from writing the whole measurement into the filter, once for each use
    kept = measure(docs).withColumn("q_row", F.monotonically_increasing_id()).where(F.col("kept") & (F.col("q_row") >= 0))
    text = F.col("clean_text")
    return kept.select(*[text.alias("text") if c == "text" else F.length(text).cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])
