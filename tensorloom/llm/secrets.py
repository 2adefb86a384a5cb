"""Secret scans: base patterns, and multipart credentials linked by an interval join.

Base kinds are reported wherever they match. Weak parts -- an account name, a mixed
random-looking token, a service address -- mean little alone; one is reported only when a
complementary part lies within ``reach`` code points of it in the same document (its
scope): identifiers and endpoints need a secret, weak secrets an identifier or endpoint.

Everything is a DataFrame expression. Positions come from the gaps that ``split`` leaves
between matches; only documents with a match leave their row, as narrow part rows. The
link is a left-semi join on (document, stretch of text), which emits no pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.functions.arrays import bind
from tensorloom.llm.common import BROADCAST_BYTES, small, stored, text_of, unused

REACH = 200  # code points between complementary parts
STRETCH = 256  # code points of one join cell

#: kind -> (class, pattern, group whose length counts, least length, weak)
KINDS = {
    "assign": ("secret", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, False),
    "access": ("ident", r"AKIA[A-Z0-9]+", 0, 20, False),
    "hex": ("secret", r"[0-9a-f]+", 0, 24, False),
    "ident": ("ident", r"""(?i:access_?key_?id|client_?id|account_?name|user_?name|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]+)""", 1, 3, True),
    "mixed": ("secret", r"[A-Za-z0-9+/]{32,}", 0, 32, True),
    "endpoint": ("endpoint", r"""(?i:https?|ftp|jdbc:[a-z]+|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\s"'<>]+""", 0, 10, True),
}
#: a quick test that any text with a counting match passes
HINTS = {"access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}", "endpoint": "://"}
MIXED = ("[a-z]", "[A-Z]", "[0-9]")  # a mixed token holds one of each
BASE = [k for k, v in KINDS.items() if not v[4]]


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """One row per document: (doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked).

    ``spans`` lists kind:start:end by start, then kind in the order of ``KINDS``; end is
    exclusive, both count code points. Null texts are empty; texts without spans have an
    empty list. Repeated rows each get the same result; other columns are ignored.
    """
    keyed = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("_text"))
    found = stored(keyed.select("doc_id", _key("doc_id", F.col("_text")).alias("_k"), _matches(F.col("_text")).alias("_m")), "secret-matches")
    listed = _listed(found, reach)
    all_spans = F.coalesce("_spans", F.expr("cast(array() as array<struct<start:int,rank:int,kind:string,end:int>>)"))
    out = found.select("doc_id", "_k").join(listed, "_k", "left").withColumn("_spans", all_spans)
    base = F.filter("_spans", lambda s: s["kind"].isin(BASE))
    count = lambda kind: F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long")
    return out.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("_spans")).alias("spans"),
        F.size(F.filter("_spans", lambda s: ~s["kind"].isin(BASE))).cast("long").alias("n_linked"),
    )


def redact_secrets(
    docs: DataFrame, *, text_col: str = "text", mask: str = "[SECRET]", reach: int = REACH, limit: int = BROADCAST_BYTES
) -> DataFrame:
    """``docs`` with every reported span of the text replaced by ``mask``.

    Touching or overlapping spans give one mask. All columns and rows stay, whatever the
    names of the other columns; rows without spans, null texts included, are unchanged.

    Texts don't move: the masked stretches, narrow rows keyed by text, go to the documents
    while they are within ``limit`` bytes. Beyond that only documents with some match are
    shuffled, all others pass by.
    """
    key, spans = unused(docs, "_k"), unused(docs, "_masked")
    text = text_of(text_col)
    found = docs.select(_key(None, text).alias("_k"), _matches(text).alias("_m")).where(F.size("_m") > 0)
    masked = stored(_masked(stored(found, "secret-matches"), reach), "secret-masks").withColumnsRenamed({"_k": key, "_masked": spans})
    if small(masked, F.lit(160) + 24 * F.size(spans), limit):
        met = docs.withColumn(key, _key(None, text)).join(F.broadcast(masked), key, "left")
        return met.withColumn(text_col, _without(text_col, spans, mask)).select(*docs.columns)
    may = F.size(_matches(text)) > 0
    met = docs.where(may).withColumn(key, _key(None, text)).join(masked, key, "left")
    return met.withColumn(text_col, _without(text_col, spans, mask)).select(*docs.columns).unionAll(docs.where(~may))


PIECE = 1024  # code points


def _without(text_col: str, spans: str, mask: str) -> Column:
    """The text with its masked stretches, which don't touch, replaced.

    It is cut once into pieces of fixed length, so that a place far inside is found at
    once: the work is linear in the text, however many stretches it has.
    """
    zero = F.lit(0)

    def rebuilt(pieces: Column, total: Column) -> Column:
        def between(a: Column, b: Column) -> Column:
            i, j = F.floor(a / PIECE).cast("int"), F.floor((b - 1) / PIECE).cast("int")
            first = F.substring(F.get(pieces, i), a % PIECE + 1, F.lit(PIECE))
            last = F.substring(F.get(pieces, j), F.lit(1), (b - 1) % PIECE + 1)
            whole = F.array_join(F.slice(pieces, i + 2, F.greatest(j - i - 1, zero)), "")
            alone = F.substring(F.get(pieces, i), a % PIECE + 1, b - a)
            return F.when(b <= a, F.lit("")).when(i == j, alone).otherwise(F.concat(first, whole, last))

        at = F.col(spans)
        kept = F.transform(at, lambda s, k: F.concat(between(F.when(k > 0, F.get(at, k - 1)["end"]).otherwise(zero), s["start"]), F.lit(mask)))
        return F.concat(F.array_join(kept, ""), between(F.get(at, F.size(at) - 1)["end"], total))

    pieces = F.regexp_extract_all(F.col(text_col), F.lit(f"(?s).{{1,{PIECE}}}+"), zero)
    masked = bind(pieces, lambda p: rebuilt(p, F.length(text_col)))
    return F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(masked)


def _masked(found: DataFrame, reach: int) -> DataFrame:
    """(_k, _masked): stretches under the reported spans, in order; those that touch are one."""
    order = Window.partitionBy("_k").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce((F.col("start") > before).cast("int"), F.lit(1))
    joined = _reported(found, reach).select("_k", "start", "end", fresh.alias("fresh"))
    joined = joined.withColumn("nth", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    stretches = joined.groupBy("_k", "nth").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return stretches.groupBy("_k").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_masked"))


def _key(id_col: str | None, text: Column) -> Column:
    """A document's key: equal rows share it, and get the same spans."""
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("")) if id_col else F.lit("")
    return F.md5(F.concat(name, F.lit(":"), text))


def _matches(text: Column) -> Column:
    """All counting and failing matches: (kind, number, gap before it, length, whether it counts)."""
    return F.concat(*[_kind_matches(text, kind) for kind in KINDS])


def _kind_matches(text: Column, kind: str) -> Column:
    _, pattern, group, least, _ = KINDS[kind]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    counts = lambda p: reduce(
        lambda a, b: a & b, [F.length(p) >= least, *[p.rlike(m) for m in (MIXED if kind == "mixed" else ())]]
    )
    rows = F.transform(
        F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("hit"), part.alias("part")),
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"),
            i.cast("int").alias("pos"),
            F.length(x["gap"]).alias("gap"),
            F.length(x["hit"]).alias("len"),
            F.coalesce(counts(x["part"]), F.lit(False)).alias("ok"),
        ),
    )
    none = F.expr("cast(array() as array<struct<kind:string,pos:int,gap:int,len:int,ok:boolean>>)")
    return F.when(text.rlike(HINTS.get(kind, pattern)), rows).otherwise(none)


def _parts(found: DataFrame) -> DataFrame:
    """Counting matches with positions: (_k, kind, start, end)."""
    each = found.where(F.size("_m") > 0).dropDuplicates(["_k"]).select("_k", F.inline("_m"))
    order = Window.partitionBy("_k", "kind").orderBy("pos")
    stop = F.sum(F.col("gap") + F.coalesce("len", F.lit(0))).over(order)
    placed = each.withColumn("end", stop.cast("int")).where("ok")
    return placed.select("_k", "kind", (F.col("end") - F.col("len")).alias("start"), "end")


def _reported(found: DataFrame, reach: int) -> DataFrame:
    """Base spans and linked weak ones: (_k, kind, start, end)."""
    parts = stored(_parts(found), "secret-parts")
    return parts.where(F.col("kind").isin(BASE)).union(linked_parts(parts, reach))


def _listed(found: DataFrame, reach: int) -> DataFrame:
    """Reported spans per document key, in order."""
    reported = _reported(found, reach)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    span = F.struct("start", rank.alias("rank"), "kind", "end")
    return reported.groupBy("_k").agg(F.sort_array(F.collect_list(span)).alias("_spans"))


def linked_parts(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """Weak parts (_k, kind, start, end) with a complementary part within ``reach``."""
    side = lambda which: F.coalesce(*[F.when(F.col("kind") == k, F.lit(v[0])) for k, v in KINDS.items() if which(v)])
    cell = lambda c: F.floor(c / F.lit(STRETCH)).cast("int")
    # a part stands in each cell it covers, a weak one also in those it can reach; a part that
    # ends just at reach has its last code point one before it
    weak = parts.withColumn("class", side(lambda v: v[4])).where(F.col("class").isNotNull())
    weak = weak.withColumn("cell", F.explode(F.sequence(cell(F.greatest(F.col("start") - reach - 1, F.lit(0))), cell(F.col("end") + reach))))
    other = parts.select(
        "_k",
        side(lambda v: True).alias("class2"),
        F.col("start").alias("start2"),
        F.col("end").alias("end2"),
        F.explode(F.sequence(cell(F.col("start")), cell(F.col("end") - 1))).alias("cell"),
    )
    near = (F.col("start2") - F.col("end") <= reach) & (F.col("start") - F.col("end2") <= reach)
    fits = ((F.col("class") == "secret") != (F.col("class2") == "secret"))
    met = weak.join(other.withColumnRenamed("_k", "_k2").withColumnRenamed("cell", "cell2"),
                    (F.col("_k") == F.col("_k2")) & (F.col("cell") == F.col("cell2")) & near & fits, "left_semi")
    return met.select("_k", "kind", "start", "end").distinct()


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
