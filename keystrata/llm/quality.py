"""Line-first quality rules, in DataFrame functions only: one pass over the texts, no shuffle.

Rules judge each line by itself, lines that fail go, and a document that loses too many of its words goes too. Base
figures of the whole text (repeated windows, symbols, repeated lines) come from the same pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are runs of anything but these.
SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"
SYMBOLS = r"[#*$%&|<>]"
#: A line may end a sentence, a clause, a quotation or a bracket with one of these.
ENDINGS = ".!?…:;,\"'”’)»]}。！？"
BOILERPLATE = r"(?i)cookie policy|uses? cookies|privacy policy|terms of (use|service)|all rights reserved|enable javascript|subscribe to our|click here|powered by|skip to content|lorem ipsum"
#: The same phrases behind a look at two letters that one of them must begin with, which spares most places the alternatives.
FAST_BOILERPLATE = BOILERPLATE.replace("(?i)", "(?i)(?=[acelpstu][eklnorsu])(?:") + ")"
#: Of a line's words, at most this share may carry runs of symbols or exclamation marks.
NOISE_PERCENT = 30
#: A line of fewer words than this needs an ending, else it counts as navigation.
NAVIGATION_WORDS = 5
#: A document that loses more than this share of its words to failed lines is rejected.
LOSS_PERCENT = 50


def failed_line(line: Column, n: Column) -> Column:
    """True for a line of ``n`` words that breaks a rule; false for a line without words."""
    bare = F.btrim(line, F.lit(" \t\r\x0b\x0c"))
    noise = F.regexp_count(line, F.lit(rf"!!+|{SYMBOLS}+")) * 100 > n * NOISE_PERCENT
    shouting = (n >= 5) & ~F.rlike(line, F.lit(r"\p{Ll}")) & F.rlike(line, F.lit(r"\p{Lu}"))
    navigation = (n < NAVIGATION_WORDS) & ~F.contains(F.lit(ENDINGS), F.right(bare, F.lit(1)))
    separators = F.regexp_count(line, F.lit("[|»›·•]"))
    navigation = navigation | ((separators >= 3) & (separators * 100 > n * NOISE_PERCENT))
    return (n > 0) & (noise | shouting | navigation | F.rlike(line, F.lit(FAST_BOILERPLATE)))


def _bind(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns through a one-row generator, so that no later filter or lambda repeats their computation.

    The optimiser pushes filters below a projection by copying its expressions; below a generator it cannot.
    """
    packed = F.explode(F.array(F.struct(*(c.alias(k) for k, c in columns.items()))))
    return df.select("*", packed.alias("__bound")).select("*", *(F.col(f"__bound.{k}").alias(k) for k in columns)).drop("__bound")


def judge(docs: DataFrame, text_col: str = "text", percent_repeated: int = 20, least_words: int = 10) -> DataFrame:
    """``docs`` with one struct column ``quality`` more (any column of that name is replaced).

    Fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, kept (boolean),
    lost_words (long) and clean_text (the text without failed lines; null stays null). A null, empty or blank text has
    no words, so it fails the base rule. Repeated rows are judged alike, row by row; an empty table stays empty. Positions in
    a text fit an int, so any text that Spark can hold is judged whole.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    step = docs.drop("quality")
    step = _bind(step, __w=F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != ""), __lines=F.transform(F.split(text, "\n"), lambda line: F.struct(line.alias("line"), F.regexp_count(line, F.lit(WORD)).alias("n"))))
    step = _bind(step, __h=F.when(F.size("__w") >= 5, F.expr("transform(sequence(0, size(__w) - 5), i -> xxhash64(__w[i], __w[i + 1], __w[i + 2], __w[i + 3], __w[i + 4]))")).otherwise(F.expr("cast(array() as array<bigint>)")), __judged=F.transform("__lines", lambda x: F.struct(x["line"].alias("line"), x["n"].alias("n"), failed_line(x["line"], x["n"]).alias("failed"))))
    # equal windows stand together in the sorted array: keep the places that have an equal neighbour
    places = F.expr("""transform(array(sort_array(transform(__h, (h, p) -> struct(h, p)))), s ->
        sort_array(transform(filter(s, (x, i) -> x.h = get(s, i - 1).h or x.h = get(s, i + 1).h), x -> x.p)))[0]""")
    again = F.when(F.size(F.array_distinct("__h")) < F.size("__h"), places).otherwise(F.expr("cast(array() as array<int>)"))
    covered = F.aggregate(again, F.struct(F.lit(-5).alias("last"), F.lit(0).alias("n")), lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(5), p - a["last"])).alias("n")), lambda a: a["n"])
    real = F.transform(F.filter("__judged", lambda x: x["n"] > 0), lambda x: x["line"])
    step = _bind(
        step,
        __n=F.size("__w").cast("long"),
        __chars=F.length(F.array_join("__w", "")).cast("long"),
        __symbols=F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        __dup=F.transform(F.array(real), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long"),
        __repeat=covered.cast("long"),
        __lost=F.aggregate("__judged", F.lit(0), lambda total, x: total + F.when(x["failed"], x["n"]).otherwise(0)).cast("long"),
    ).drop("__w", "__h", "__lines")
    base_failed = (F.col("__n") < least_words) | (F.col("__repeat") * 100 > F.col("__n") * percent_repeated)
    passed = F.transform(F.filter("__judged", lambda x: ~x["failed"]), lambda x: x["line"])
    clean = F.when(F.col("__lost") == 0, F.col(text_col)).otherwise(F.array_join(passed, "\n"))  # lines that fail have words
    quality = F.struct(
        F.col("__n").alias("n_words"), F.col("__chars").alias("word_chars"), F.col("__symbols").alias("n_symbols"), F.col("__dup").alias("n_dup_lines"), F.col("__repeat").alias("n_repeat_words"),
        base_failed.alias("base_failed"), (~base_failed & (F.col("__lost") * 100 <= F.col("__n") * LOSS_PERCENT)).alias("kept"), F.col("__lost").alias("lost_words"), clean.alias("clean_text"),
    )
    return _bind(step, quality=quality).drop("__judged", "__n", "__chars", "__symbols", "__dup", "__repeat", "__lost")
