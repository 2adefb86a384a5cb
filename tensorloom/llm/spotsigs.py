"""SpotSigs fingerprints: chains of content words that follow common-word anchors.

Common words are spread evenly through prose and rare in navigation and boilerplate. Each
occurrence of one (an anchor) gives a signature: the anchor and the next content words
after it. A document's fingerprint is the set of its signatures; documents are compared by
the Jaccard similarity of those sets, and since it can't exceed the ratio of their sizes,
only sets of neighbouring sizes are compared at all.

One regular expression with look-ahead finds all chains; all work is DataFrame expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.functions.arrays import bind
from tensorloom.functions.ranking import bucket_of, sample_borders
from tensorloom.llm.common import components, stored, text_of
from tensorloom.session import shuffle_width

#: fixed values: common words of English, German, French and Spanish
ANCHORS = (
    "a an and are as at be by for from in is it of on or that the this to was were with "
    "das dem den der des die ein eine für ist mit nicht sich und von zu "
    "avec dans de du elle en est et la le les pour que qui sur un une "
    "con el la las lo los no para por se su y"
).split()
CHAIN = 2  # content words of a signature
SKIP = 8  # common words passed over before a content word



def _any_of(words: list[str]) -> str:
    """A pattern for exactly these words that shares their beginnings, so a mismatch fails at once."""
    ends: dict[str, list[str]] = {}
    for word in words:
        if word:
            ends.setdefault(word[0], []).append(word[1:])
    if not ends:
        return ""
    branches = "|".join(first + _any_of(rest) for first, rest in sorted(ends.items()))
    return f"(?:{branches}){'?' if '' in words else ''}"


_STOP = _any_of(sorted(set(ANCHORS))) + " "
_NEXT = f"(?:{_STOP}){{0,{SKIP}}}+(?!{_STOP})[^ ]++ "
_SPOT = f" (?=({_STOP}{_NEXT * CHAIN}))"
# words of a text whose anchors with a whole chain are marked: such an anchor, another common word, a content word
_MARKED, _COMMON, _CONTENT = r"\+[^ ]++ ", _STOP, f"(?!{_STOP})[^ +]++ "
# all words from an anchor to the end of its chain; a chain that begins within it goes on (chains of two content words)
_COVERED = (
    f"{_MARKED}(?:(?:{_MARKED}|{_COMMON})*+{_CONTENT}(?:{_COMMON})*+{_MARKED})*+"
    f"(?:{_MARKED}|{_COMMON})*+{_CONTENT}(?:{_COMMON})*+{_CONTENT}"
)
_PAIR = " (?=([^ |]++ [^ |]++ ))"
_CHAIN = f" \\+(?=([^ ]++ (?:{_MARKED}|{_COMMON})*+{_CONTENT}(?:{_MARKED}|{_COMMON})*+{_CONTENT}))"


def signatures(text: Column) -> Column:
    """Distinct signature hashes (32 bits) of a text, sorted.

    Every chain is one. Stretches of words that no chain covers (a table, a title, the words
    between two chains) add all their pairs of neighbouring words, so a spot more or less
    changes the signatures around it and no others. The only word of a text is one; a text
    without words has none.
    """
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))

    def all_of(w: Column) -> Column:
        # the anchor, then content words only
        chains = F.transform(
            F.regexp_extract_all(w, F.lit(_CHAIN), F.lit(1)),
            lambda s: _number(F.regexp_replace(s, f" (?:{_MARKED}|{_COMMON})+", " ")),
        )
        pairs = F.transform(
            F.regexp_extract_all(F.regexp_replace(w, _COVERED, "| "), F.lit(_PAIR), F.lit(1)), lambda s: _number(F.concat(F.lit("="), s))
        )
        none = F.expr("cast(array() as array<int>)")
        alone = F.when(F.trim(w).rlike("^[^ ]+$"), F.array(_number(F.concat(F.lit("="), w)))).otherwise(none)
        return F.concat(chains, pairs, alone)

    # bound: a text is normalised, and its anchors looked for, once
    return F.sort_array(F.array_distinct(bind(F.regexp_replace(words, _SPOT, " +"), all_of)))


def _number(chain: Column) -> Column:
    return (F.conv(F.substring(F.md5(chain), 1, 8), 16, 10).cast("long") - F.lit(1 << 31)).cast("int")


def fingerprint(signs: Column) -> Column:
    """A set of signatures as text: eight hex digits each, comma-joined."""
    return F.array_join(F.transform(signs, lambda x: F.lower(F.lpad(F.hex(x.cast("long") + F.lit(1 << 31)), 8, "0"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; sizes alone settle it when one is empty."""
    shared = F.size(F.array_intersect(a, b))
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
        .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .otherwise(shared / (F.size(a) + F.size(b) - shared))
    )


def size_class(size: Column, threshold: float) -> Column:
    """Partition number of a set size: sets in partitions further apart than one can't be as alike as the threshold."""
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / F.lit(-math.log(threshold)) + F.lit(1e-9)).cast("int")


def fingerprint_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, size_class).

    The next document is that of the next smaller id, for the smallest the one with the
    largest id; the edited text has its last third replaced by the start of the next one.
    Null texts are empty. Null ids come after all others, rows with equal ids are ordered
    by text; a single document is its own next. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    placed = _with_next(rows)
    n = F.length("text")
    third = F.floor(n / F.lit(3)).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    told = placed.withColumn("edited", edited).withColumn("edited_signs", signatures(F.col("edited")))
    return told.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("signs")).alias("fingerprint"),
        fingerprint(F.col("edited_signs")).alias("edited_fingerprint"),
        likeness(F.col("signs"), F.col("edited_signs")).alias("near_edited"),
        likeness(F.col("signs"), F.col("next_signs")).alias("near_next"),
        size_class(F.size("signs"), 0.8).alias("size_class"),
    )


def _with_next(rows: DataFrame) -> DataFrame:
    """Rows with signatures and the text and signatures of the next row by descending id.

    Ids are cut into ranges at sampled borders; each range also gets the first row of the
    range after it, so every row meets its next one within its range.
    """
    spark = rows.sparkSession
    cuts = sample_borders(rows, ["doc_id"], min(4 * shuffle_width(spark), 1024))
    ranged = rows.withColumn("_range", bucket_of(rows, ["doc_id"], cuts).cast("int"))
    heads = {r["_range"]: r["head"] for r in ranged.groupBy("_range").agg(F.max("doc_id").alias("head")).collect()}  # 1025 ranges at most
    order = sorted(heads, reverse=True)
    # where the head of each range also goes: the range before it in descending order
    also = {r: order[k - 1] for k, r in enumerate(order)}
    table = F.create_map(*[F.lit(x) for r in order for x in (r, also[r])]) if order else F.lit(None)
    first = F.create_map(*[F.lit(x) for r in order for x in (r, heads[r])]) if order else F.lit(None)
    signed = ranged.withColumn("signs", signatures(F.col("text")))
    if not order:
        return signed.select("doc_id", "text", "signs", F.col("text").alias("next_text"), F.col("signs").alias("next_signs"))
    is_head = F.col("doc_id").eqNullSafe(F.element_at(first, F.col("_range")))
    own = F.struct(F.col("_range").alias("r"), F.lit(0).alias("ghost"))
    ghost = F.struct(F.element_at(table, F.col("_range")).alias("r"), F.lit(1).alias("ghost"))
    to = F.explode(F.when(is_head, F.array(own, ghost)).otherwise(F.array(own)))
    both = signed.withColumn("_to", to).select("_to.r", "_to.ghost", "doc_id", "text", "signs")
    within = Window.partitionBy("r").orderBy("ghost", F.desc_nulls_last("doc_id"), "text")
    moved = both.withColumn("_next", F.lead(F.struct("text", "signs")).over(within)).where("ghost = 0")
    return moved.select(
        "doc_id", "text", "signs", F.col("_next.text").alias("next_text"), F.col("_next.signs").alias("next_signs")
    )


def spot_join(docs: DataFrame, threshold: float = 0.8, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near duplicates by fingerprints: rows (doc_id, copy_id, class_id).

    Equal fingerprints are copies (``copy_id`` is their least id). Distinct fingerprints are
    compared when their size partitions touch and they share one of their rarest signatures:
    with signatures ordered by frequency, sets as alike as the threshold must share one among
    the first ``n - ceil(threshold * n) + 1``. Both bounds lose no pair. ``class_id`` is the
    least id reachable through such pairs. Texts without words are their own class.
    """
    signed = stored(
        docs.select(F.col(id_col).alias("doc_id"), signatures(text_of(text_col)).alias("signs")).withColumn("key", F.md5(fingerprint(F.col("signs")))),
        "spot-signs",
    )
    full = signed.where(F.size("signs") > 0)
    sets = full.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("signs").alias("signs"))
    sets = stored(sets.withColumn("n", F.size("signs")), "spot-sets")
    each = sets.select("key", F.explode("signs").alias("sign"))
    count = each.groupBy("sign").agg(F.count(F.lit(1)).alias("df"))
    ranked = each.join(count, "sign").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("df", "sign"))).alias("s"))
    keep = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9).cast("int") + 1
    rare = ranked.join(sets, "key").withColumn("sign", F.explode(F.transform(F.slice("s", F.lit(1), keep), lambda x: x["sign"])))
    rare = stored(rare.select("key", "sign", "n", size_class(F.col("n"), threshold).alias("c")), "spot-rare")
    a = rare.select(F.col("key").alias("u"), "sign", F.col("n").alias("n1"), F.col("c"))
    b = rare.select(F.col("key").alias("v"), "sign", F.col("n").alias("n2"), F.explode(F.array(F.col("c"), F.col("c") + 1)).alias("c"))
    fits = (F.least("n1", "n2") >= F.greatest("n1", "n2") * threshold - 1e-9) & (F.col("u") != F.col("v"))
    met = a.join(b, ["sign", "c"]).where(fits).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    left = sets.select(F.col("key").alias("u"), F.col("signs").alias("s1"))
    right = sets.select(F.col("key").alias("v"), F.col("signs").alias("s2"))
    edges = met.join(left, "u").join(right, "v").where(likeness(F.col("s1"), F.col("s2")) >= threshold).select("u", "v")
    roots = components(edges)
    least = roots.join(sets, F.col("id") == F.col("key")).groupBy("root").agg(F.min("rep").alias("class_id"))
    told = sets.join(roots.join(least, "root"), F.col("key") == F.col("id"), "left").select(
        F.col("key").alias("key2"), F.col("rep").alias("copy_id"), F.coalesce("class_id", "rep").alias("class_id")
    )
    wordless = F.when(F.size("signs") == 0, F.concat(F.lit("-"), F.col("doc_id").cast("string"))).otherwise(F.col("key"))
    return (
        signed.select("doc_id", wordless.alias("key"))
        .join(told, F.col("key") == F.col("key2"), "left")
        .select("doc_id", F.coalesce("copy_id", "doc_id").alias("copy_id"), F.coalesce("class_id", "doc_id").alias("class_id"))
    )
