"""Mixing sources to target weights by iterative proportional fitting (raking).

Token counts form a table of (source, language, topic) cells. Raking finds factors
a(source) * b(language) * c(topic) that bring all three margins of the weighted tokens to
their targets; documents are then sampled with probabilities that keep those weights and
spend the token budget.

Sources may be many, languages and topics are few. Cells are therefore kept as one row
per source, and a round is one pass over those rows: each source's factor follows from the
current language and topic factors, and the sums left over (languages x topics) are all the
driver needs to move the other two. No text is read after the counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.functions.hashing import hash32, unit
from tensorloom.llm.common import stored, text_of

ROUNDS = 60
CLOSE = 1e-6  # largest relative error of a margin
TEMPER = 0.7  # default targets: share of tokens to this power
BUDGET = 0.5  # share of all tokens to draw
SEED = 5
UNKNOWN = ""


def topic_of(text: Column) -> Column:
    """A coarse genre that any text has: table, markup, noise, notice, short or prose."""
    return (
        F.when(text.contains(" | "), "table")
        .when(text.rlike(r"<[a-zA-Z/][^>]*>"), "markup")
        .when(text.rlike(r"[#$%&*]{3}"), "noise")
        .when(text.rlike(r"(?i:licensed under|all rights reserved|copyright)"), "notice")
        .when(F.length(text) < 500, "short")
        .otherwise("prose")
    )


def tokens_of(text: Column) -> Column:
    """Runs of characters other than white space."""
    return F.regexp_count(text, F.lit(r"\S+")).cast("long")


def mix_documents(
    docs: DataFrame,
    *,
    budget: float = BUDGET,
    temper: float = TEMPER,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
) -> DataFrame:
    """Rows (doc_id, source, lang, topic, tokens, weight, prob, kept, margin_error), one per row of ``docs``.

    ``weight`` is the raked weight of the document's tokens relative to their count,
    ``prob`` its probability of being drawn, ``kept`` the draw, made from a hash of the id.
    Null sources and languages are the category ''; null texts are empty. Texts without
    tokens have weight and probability of their cell, 0 if no text of it has tokens.
    Repeated rows are drawn alike. ``margin_error`` is how far, relatively, the worst margin of the
    fit is from its target: above ``CLOSE`` the rounds ended before the targets were met, or
    they can't be met together. An empty table gives no rows.
    """
    rows = stored(_described(docs, id_col, text_col, source_col, lang_col), "mix-rows")
    model = fit_mixture(rows, budget=budget, temper=temper)
    return _drawn(rows, model, seed).select("doc_id", "source", "lang", "topic", "tokens", "weight", "prob", "kept", F.lit(model["error"]).alias("margin_error"))


def sample_mixture(docs: DataFrame, *, budget: float = BUDGET, temper: float = TEMPER, seed: int = SEED, id_col="doc_id", text_col="text", source_col="source", lang_col="lang") -> DataFrame:
    """The documents that :func:`mix_documents` keeps, with their own columns."""
    described = _described(docs, id_col, text_col, source_col, lang_col)
    model = fit_mixture(stored(described.select("source", "lang", "topic", "tokens"), "mix-rows"), budget=budget, temper=temper)
    text = text_of(text_col)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    marked = docs.select(
        whole.alias("_row"),
        F.col(id_col).alias("doc_id"),
        _name(source_col).alias("source"),
        _name(lang_col).alias("lang"),
        topic_of(text).alias("topic"),
        F.lit(1).cast("long").alias("tokens"),
    )
    return _drawn(marked, model, seed).where("kept").select("_row.*")


def _name(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(UNKNOWN))


def _described(docs, id_col, text_col, source_col, lang_col) -> DataFrame:
    text = text_of(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        _name(source_col).alias("source"),
        _name(lang_col).alias("lang"),
        topic_of(text).alias("topic"),
        tokens_of(text).alias("tokens"),
    )


def _factor(values: dict[str, float], key: Column) -> Column:
    """Constant lookup; languages and topics are few by contract."""
    if not values:
        return F.lit(0.0)
    table = F.create_map(*[F.lit(x) for pair in sorted(values.items()) for x in pair])
    return F.coalesce(F.try_element_at(table, key), F.lit(0.0))


def _tempered(totals: dict[str, float], temper: float) -> dict[str, float]:
    raised = {k: v**temper if v > 0 else 0.0 for k, v in totals.items()}
    whole = sum(raised.values())
    return {k: v / whole if whole else 0.0 for k, v in raised.items()}


def fit_mixture(rows: DataFrame, *, budget: float = BUDGET, temper: float = TEMPER, rounds: int = ROUNDS) -> dict:
    """Raked factors: {"sources": DataFrame(source, a), "langs", "topics": dicts, "scale": tokens -> probability, "error"}.

    ``rows`` has (source, lang, topic, tokens). Targets are the token shares of each margin
    to the power ``temper``. ``scale`` makes the expected tokens drawn ``budget`` times all
    tokens, probabilities capped at one. ``error`` is the largest relative error of a margin in
    the last round: not above ``CLOSE`` when the fit converged before ``rounds`` ran out.
    """
    cells = rows.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"))
    cell = F.struct("lang", "topic", "tokens")
    total = F.aggregate("cells", F.lit(0.0), lambda s, x: s + x["tokens"])
    sources = stored(cells.groupBy("source").agg(F.collect_list(cell).alias("cells")).withColumn("target", F.pow(total, F.lit(temper))), "mix-sources")
    whole = sources.agg(F.coalesce(F.sum("target"), F.lit(0.0)), F.coalesce(F.sum(total), F.lit(0.0))).first()
    shares, tokens = whole[0] or 1.0, whole[1]

    def sums(b: dict, c: dict, a: Column) -> dict:
        """Tokens weighted by the source factor, per (language, topic)."""
        each = sources.select(a.alias("a"), F.explode("cells").alias("x"))
        out = each.groupBy("x.lang", "x.topic").agg(F.sum(F.col("a") * F.col("x.tokens")).alias("w")).collect()
        return {(r["lang"], r["topic"]): r["w"] for r in out}

    plain = sums({}, {}, F.lit(1.0))
    langs, topics = sorted({k[0] for k in plain}), sorted({k[1] for k in plain})
    want_lang = _tempered({k: sum(v for x, v in plain.items() if x[0] == k) for k in langs}, temper)
    want_topic = _tempered({k: sum(v for x, v in plain.items() if x[1] == k) for k in topics}, temper)
    b, c = dict.fromkeys(langs, 1.0), dict.fromkeys(topics, 1.0)
    ratio = 1.0

    def source_factor() -> Column:
        reached = F.aggregate("cells", F.lit(0.0), lambda s, x: s + x["tokens"] * _factor(b, x["lang"]) * _factor(c, x["topic"]))
        return F.when(reached > 0, F.col("target") / F.lit(shares) / reached).otherwise(F.lit(0.0))

    for _ in range(rounds if tokens else 0):
        w = sums(b, c, source_factor())
        ratio = 1.0
        for own, want, at, factors in ((langs, want_lang, 0, b), (topics, want_topic, 1, c)):
            for k in own:
                now = sum(v * b[x[0]] * c[x[1]] for x, v in w.items() if x[at] == k)
                step = want[k] / now if now > 0 else 1.0
                factors[k] *= step
                if want[k] > 0:
                    ratio = max(ratio, step, 1 / step)
        if ratio - 1 < CLOSE:
            break
    fitted = stored(sources.select("source", source_factor().alias("a"), "cells"), "mix-factors")
    return {"sources": fitted.select("source", "a"), "langs": b, "topics": c, "scale": _scale(fitted, b, c, budget * tokens), "error": ratio - 1}


def _scale(fitted: DataFrame, b: dict, c: dict, wanted: float) -> float:
    """The k for which the sum over cells of tokens * min(1, k * weight) is ``wanted``; a few passes over the cells."""
    weight = F.col("a") * _factor(b, F.col("x.lang")) * _factor(c, F.col("x.topic"))
    cells = fitted.select("a", F.explode("cells").alias("x")).select(weight.alias("w"), F.col("x.tokens").alias("t")).where("w > 0 and t > 0")
    edge = cells.agg(F.min("w"), F.max("w"), F.sum("t")).first()
    if edge[2] is None:
        return 0.0
    low, high = 0.0, 1.0 / edge[0]
    if edge[2] <= wanted:
        return high
    spent = lambda k: F.sum(F.col("t") * F.least(F.lit(1.0), F.lit(k) * F.col("w")))
    for _ in range(5):
        steps = [low + (high - low) * i / 32 for i in range(1, 32)]
        got = cells.agg(*[spent(k) for k in steps]).first()
        under = [k for k, v in zip(steps, got, strict=True) if v <= wanted]
        over = [k for k, v in zip(steps, got, strict=True) if v > wanted]
        low, high = max([low, *under]), min([high, *over])
    return low


def _drawn(rows: DataFrame, model: dict, seed: int) -> DataFrame:
    joined = rows.join(model["sources"], "source", "left")  # small unless sources are many: then a plain join
    weight = F.coalesce("a", F.lit(0.0)) * _factor(model["langs"], F.col("lang")) * _factor(model["topics"], F.col("topic"))
    prob = F.least(F.lit(1.0), F.col("weight") * F.lit(model["scale"]))
    draw = unit(hash32("mix", seed, F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return joined.withColumn("weight", weight).withColumn("prob", prob).withColumn("kept", draw < F.col("prob"))
