"""Fill-in-the-middle texts by counted-quantifier regular expressions, in built-in functions throughout.

A text's code points are counted by `regexp_count`: full runs of RUN code points, then those of what is left, so that the
matches held for a text are few. A pattern per row, `unit{a}+` and `unit{b-a}+` possessive and the rest, captures prefix, middle
and suffix in one match, and the row's replacement puts them in the order of its form. Possessive groups of a fixed count never
give back what they have matched, so the match takes one pass.

The other way, one match of the markers' pattern gives the text back: no piece holds a marker and a marker can't begin within
the end of another one, so the first occurrence of each is the marker itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 1
PLAIN_FROM, SPM_BELOW = 90, 20
RUN = 1024
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Form -> markers and groups of the cutting pattern, and the way back.
ORDERS = {
    "psm": (f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2", rf"(?s)\A{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*+)\z", "$1$3$2"),
    "spm": (f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2", rf"(?s)\A{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*+)\z", "$2$3$1"),
}


def units(text: Column | str) -> Column:
    """Code points of a text."""
    text = F.col(text) if isinstance(text, str) else text
    runs = F.regexp_count(text, F.lit(f"(?s).{{{RUN}}}+")).cast("bigint")
    left = F.substring(text, (runs * RUN + 1).cast("int"), F.lit(RUN))
    return runs * RUN + F.regexp_count(left, F.lit("(?s).")).cast("bigint")


def cut_pattern(first: Column, second: Column) -> Column:
    """`first` code points, then those up to `second`, then the rest."""
    return F.concat(F.lit(r"(?s)\A(.{"), first, F.lit(r"}+)(.{"), second - first, F.lit(r"}+)(.*+)\z"))


def transformed(documents: DataFrame, seed: int = SEED, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """Per document row: doc_id, n (code points), form, prefix_chars, middle_chars, output.

    Draws h1 to h4 are the first 8-digit groups of the sha256 of `seed:doc_id`; prefix and middle end behind the smaller and the
    larger of h1 and h2 modulo n + 1. The form is plain for an empty text, one with a marker in it, or h3 % 100 >= plain_from;
    else spm for h4 % 100 < spm_below, else psm. A null text is empty. A null doc_id draws as the empty id. Rows of equal doc_id
    draw the same numbers, each for its own text. Other columns are not read.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id", "text", units("text").alias("n"),
        *[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint").alias(f"h{i + 1}") for i in range(4)],
    )
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("n") == 0) | marked | (F.col("h3") % 100 >= plain_from)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_below, "spm").otherwise("psm")
    x, y = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    placed = rows.select("doc_id", "text", "n", form.alias("form"), F.least(x, y).alias("first"), F.greatest(x, y).alias("second"))
    order = F.when(F.col("form") == "psm", ORDERS["psm"][0]).otherwise(ORDERS["spm"][0])
    moved = F.regexp_replace("text", cut_pattern(F.col("first"), F.col("second")), order)
    cut = F.col("form") != "plain"
    return placed.select(
        "doc_id", "n", "form", F.when(cut, F.col("first")).alias("prefix_chars"), F.when(cut, F.col("second") - F.col("first")).alias("middle_chars"),
        F.when(cut, moved).otherwise(F.col("text")).alias("output"),
    )


def restored(output: Column | str = "output", form: Column | str = "form") -> Column:
    """The text that an output and its form came from."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    back = F.when(form == "plain", output)
    for name, (_, pattern, groups) in ORDERS.items():
        back = back.when(form == name, F.regexp_replace(output, F.lit(pattern), F.lit(groups)))
    return back
