"""Fill-in-the-middle transformation by counted quantifiers.

A text is a row of units: runs of ASCII letters, and every other code point alone. One
count gives their number n; two numbers drawn from the document's id cut the units into
prefix, middle and suffix. A pattern made for the row, with possessive groups ``unit{a}``
and ``unit{b-a}``, takes all three parts in one match, which rewrites the text into its
output at once. Possessive groups never give anything back, so the match is one pass
without a stack, whatever the length. Everything is a DataFrame expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import text_of

#: fixed values: the marks before prefix, suffix and middle
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = f"{PREFIX}|{SUFFIX}|{MIDDLE}"
UNIT = "[A-Za-z]+|[^A-Za-z]"
PLAIN_PERCENT = 10  # documents left as they are
SPM_PERCENT = 20  # of the others, those with the suffix first

#: pattern groups: 1 prefix, 2 middle, 3 suffix
ORDERS = {"psm": f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2", "spm": f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2"}
#: form -> (pattern of an output, the text it came from)
BACK = {
    "psm": (rf"(?s)\A{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*)", "$1$3$2"),
    "spm": (rf"(?s)\A{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*)", "$2$3$1"),
}


def draws(id_col: str | Column, seed: int = 1) -> list[Column]:
    """Four numbers of 32 bits from a document's id; a null id counts as an empty one."""
    name = F.coalesce((F.col(id_col) if isinstance(id_col, str) else id_col).cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), name), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 1) -> DataFrame:
    """Rows (doc_id, text, n, form, prefix_chars, middle_chars, output), one per row of ``docs``.

    ``form`` is ``plain`` (output is the text) for empty texts, texts that hold a mark and
    the drawn tenth; otherwise ``psm`` or ``spm``. The lengths count code points and are null
    for plain rows. Null texts are empty. Repeated rows, and rows of one id with equal texts,
    get equal results; other columns are ignored.
    """
    h1, h2, h3, h4 = draws("doc_id", seed)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    counted = rows.withColumn("n", F.regexp_count("text", F.lit(UNIT)).cast("long"))
    cut = counted.withColumn("_u", F.pmod(h1, F.col("n") + 1)).withColumn("_v", F.pmod(h2, F.col("n") + 1))
    plain = (F.col("n") == 0) | F.col("text").rlike(MARKS) | (F.pmod(h3, F.lit(100)) >= 100 - PLAIN_PERCENT)
    form = F.when(plain, "plain").when(F.pmod(h4, F.lit(100)) < SPM_PERCENT, "spm").otherwise("psm")
    unit = f"(?:{UNIT.replace('+', '++')})"
    first, both = F.least("_u", "_v"), F.greatest("_u", "_v")
    pattern = F.format_string(rf"(?s)\A({unit}{{%d}}+)({unit}{{%d}}+)(.*+)", first, both - first)
    shaped = cut.withColumn("form", form).withColumn(
        "output",
        F.when(F.col("form") == "plain", F.col("text"))
        .when(F.col("form") == "psm", F.regexp_replace("text", pattern, F.lit(ORDERS["psm"])))
        .otherwise(F.regexp_replace("text", pattern, F.lit(ORDERS["spm"]))),
    )
    # marks don't occur in the parts and can't overlap, so the first of each one is the mark itself
    at = lambda mark: F.instr("output", mark)
    before = F.when(F.col("form") == "psm", at(SUFFIX) - 1 - len(PREFIX)).otherwise(at(MIDDLE) - at(PREFIX) - len(PREFIX))
    after = F.length("output") - (at(MIDDLE) - 1 + len(MIDDLE))
    told = lambda c: F.when(F.col("form") != "plain", c).cast("long")
    return shaped.select(
        "doc_id", "text", "n", "form", told(before).alias("prefix_chars"), told(after).alias("middle_chars"), "output"
    )


def restore(output: Column, form: Column) -> Column:
    """The text an output of :func:`fill_in_middle` was made from; one match for each form."""
    back = output
    for name, (pattern, order) in BACK.items():
        back = F.when(form == name, F.regexp_replace(output, F.lit(pattern), F.lit(order))).otherwise(back)
    return back
