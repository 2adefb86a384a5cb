"""Periodic runs of words, found on a grammar instead of the text.

Re-Pair turns the word ids of a slice of documents into a grammar: the most frequent pair of
neighbouring symbols becomes a nonterminal, until no pair occurs twice. Pairs that don't
contest a place are replaced in the same round, the more frequent one first where they do.
What remains of each document is paired up evenly, so each document is one symbol and its
derivation is shallow. A run lies across the boundary between the two parts of the smallest
derivation node that holds it. So runs are looked for once per nonterminal, across its
boundary, at one of its occurrences; they are then translated to all the others, and
intervals that lie inside another one of the same period are merged into it.

Documents are rows of Spark tasks; a slice holds a bounded number of words (at least one
document), and its arrays are the memory a task needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.functions.arrays import bind
from tensorloom.llm.common import text_of

LEAST = 12  # words of a run
SLICE_WORDS = 1 << 17
CHUNK = 1 << 21  # (boundary, period) pairs tested at once
RUNS = "doc_id long, n long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
#: fixed value: words are separated by these ASCII characters, as ``bytes.split`` does
WORD = r"[^\x20\x09-\x0D]+"


def periodic_runs(docs: DataFrame, *, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n, runs, collapsed), one per row of ``docs``.

    A run is a stretch of words with smallest period q, as long as ``least`` and 2q, that
    no neighbouring word extends. ``runs`` lists (start, length, period) by start, then period.
    ``collapsed`` has every word that no run holds after its first period, joined by one space.
    Null and empty texts have n = 0, no runs and an empty text. Repeated rows get equal
    results; other columns are ignored.
    """
    if least < 2:
        raise ValueError("a run has two words at least")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: list[list[bytes]] = []
            first = held = 0
            for row in range(batch.num_rows):
                words.append((batch.column(1)[row].as_py() or "").encode().split())
                held += len(words[-1])
                if held >= SLICE_WORDS or row == batch.num_rows - 1:
                    yield _told(batch.column(0).slice(first, len(words)), words, least)
                    first, held, words = row + 1, 0, []

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(find, RUNS)


class Names(dict):
    """Numbers for words, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def _told(ids: pa.Array, docs: list[list[bytes]], least: int) -> pa.RecordBatch:
    names = Names()
    sizes = np.array([len(d) for d in docs], np.int64)
    # a wall after each document: a symbol that occurs once and pairs with nothing
    starts = np.cumsum(sizes + 1) - sizes - 1
    text = np.zeros(int((sizes + 1).sum()), np.int64)
    for at, words in zip(starts.tolist(), docs, strict=True):
        text[at : at + len(words)] = list(map(names.__getitem__, words))
    walls = starts + sizes
    text[walls] = len(names) + np.arange(len(walls))
    start, stop, period = find_runs(text, walls, least)
    doc = np.searchsorted(starts, start, "right") - 1
    order = np.lexsort((period, start))
    start, stop, period, doc = (a[order] for a in (start, stop, period, doc))
    edges = np.zeros(len(text) + 1, np.int64)
    np.add.at(edges, start + period, 1)
    np.add.at(edges, stop, -1)
    gone = np.cumsum(edges[:-1]) > 0
    collapsed = []
    for at, words, any_gone in zip(starts.tolist(), docs, np.isin(np.arange(len(docs)), doc).tolist(), strict=True):
        if any_gone:
            words = [w for w, g in zip(words, gone[at : at + len(words)].tolist(), strict=True) if not g]
        collapsed.append(b" ".join(words))
    runs = pa.StructArray.from_arrays(
        [pa.array(start - starts[doc]), pa.array(stop - start), pa.array(period)], ["start", "length", "period"]
    )
    offsets = np.searchsorted(doc, np.arange(len(docs) + 1), "left")
    return pa.RecordBatch.from_arrays(
        [
            ids,
            pa.array(sizes),
            pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs),
            pa.array(collapsed, pa.binary()).cast(pa.string()),
        ],
        ["doc_id", "n", "runs", "collapsed"],
    )


# ---- the grammar -------------------------------------------------------------------


def _scattered(key: np.ndarray) -> np.ndarray:
    return ((key * np.int64(0x9E3779B97F4A7C1)) >> np.int64(30)) & np.int64(0x3FFFFFFF)


def _repeated(at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The places whose key occurs again, their number among these keys, the keys and their counts."""
    mask = np.int64((1 << max(len(key).bit_length() + 1, 4)) - 1)
    slot = _scattered(key) & mask
    maybe = np.flatnonzero(np.bincount(slot, minlength=1)[slot] > 1)  # cheap: a lone slot is a lone key
    which, unique = pd.factorize(key[maybe])
    count = np.bincount(which, minlength=len(unique))
    again = np.flatnonzero(count[which] > 1)
    number = np.cumsum(count > 1) - 1
    return at[maybe[again]], number[which[again]], unique[count > 1], count[count > 1]


class Grammar:
    """Rules in the order they were made: where an occurrence starts, its boundary and its end; and all occurrences."""

    def __init__(self, text: np.ndarray, walls: np.ndarray) -> None:
        self.symbols, self.places = text.copy(), np.arange(len(text))
        self.lengths = np.ones(int(text.max()) + 1, np.int64)
        self.wall = np.zeros(len(self.lengths), bool)
        self.wall[text[walls]] = True
        self.terminals = len(self.lengths)
        self.start, self.middle, self.stop = [], [], []  # by rule, one array per round
        self.rule, self.place = [], []  # by occurrence
        while self._pair_repeated():
            pass
        while self._pair_evenly():
            pass

    def _pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.symbols[:-1], self.symbols[1:]
        return a, b, ~(self.wall[a] | self.wall[b])

    def _pair_repeated(self) -> bool:
        """One round of Re-Pair; false when no pair occurs twice."""
        a, b, ok = self._pairs()
        at = np.flatnonzero(ok)
        at, which, unique, count = _repeated(at, a[at] * np.int64(len(self.lengths)) + b[at])
        if not len(at):
            return False
        # rank of each pair: by frequency, ties in a scattered order
        rank = np.empty(len(unique), np.int64)
        rank[np.lexsort((_scattered(unique), count))] = np.arange(1, len(unique) + 1)
        weight = np.zeros(len(a) + 2, np.int64)
        # equal neighbouring pairs are stretches of one symbol, paired from their first place on
        fresh = np.r_[True, self.symbols[1:] != self.symbols[:-1]]
        since = np.arange(len(self.symbols)) - np.maximum.accumulate(np.where(fresh, np.arange(len(self.symbols)), 0))
        even = (a == b) & (since[:-1] % 2 == 0)
        weight[1 + at] = 2 * rank[which] + even[at]
        own = weight[1:-1]
        chosen = np.flatnonzero((own > 0) & (own > weight[:-2]) & (own > weight[2:]))
        self._replace(chosen, shared=True)
        return True

    def _pair_evenly(self) -> bool:
        """Pairs up neighbours in every document; false when each one is a single symbol."""
        _, _, ok = self._pairs()
        fresh = np.r_[True, self.wall[self.symbols[:-1]]]
        index = np.arange(len(self.symbols))
        since = index - np.maximum.accumulate(np.where(fresh, index, 0))
        chosen = np.flatnonzero(ok & (since[:-1] % 2 == 0))
        self._replace(chosen, shared=False)
        return len(chosen) > 0

    def _replace(self, chosen: np.ndarray, shared: bool) -> None:
        a, b, place = self.symbols[chosen], self.symbols[chosen + 1], self.places[chosen]
        if shared:
            rule, unique = pd.factorize(a * np.int64(len(self.lengths)) + b)
            first = np.empty(len(unique), np.int64)
            first[rule[::-1]] = np.arange(len(rule))[::-1]
        else:
            first = rule = np.arange(len(chosen))
        base = len(self.lengths)
        total = self.lengths[a[first]] + self.lengths[b[first]]
        self.start.append(place[first])
        self.middle.append(place[first] + self.lengths[a[first]])
        self.stop.append(place[first] + total)
        self.rule.append(rule + base - self.terminals)
        self.place.append(place)
        self.lengths = np.concatenate([self.lengths, total])
        self.wall = np.concatenate([self.wall, np.zeros(len(total), bool)])
        self.symbols[chosen] = base + rule
        keep = np.ones(len(self.symbols), bool)
        keep[chosen + 1] = False
        self.symbols, self.places = self.symbols[keep], self.places[keep]


class Repeats:
    """Lengths of common stretches from any two places: blocks of 2^k words have equal names where they are equal."""

    def __init__(self, text: np.ndarray) -> None:
        n = len(text)
        own = -1 - np.arange(n, dtype=np.int64)  # names of blocks that occur once
        at, name, _, _ = _repeated(np.arange(n), text)
        twice = np.zeros(n, bool)
        twice[at] = True
        self.names = [own.astype(np.int32)]
        self.names[0][at] = name
        half = 1
        while twice.any():
            at = np.flatnonzero(twice[: n - half] & twice[half:]) if half < n else np.zeros(0, np.int64)
            last = self.names[-1]
            at, name, _, _ = _repeated(at, last[at].astype(np.int64) * n + last[at + half])
            if not len(at):
                break
            twice = np.zeros(n, bool)
            twice[at] = True
            names = own.astype(np.int32)
            names[at] = name
            self.names.append(names)
            half *= 2

    def forward(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many words from i and j on are equal, ``limit`` at most."""
        size = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            at = np.flatnonzero(size + (1 << k) <= limit)
            same = self.names[k][i[at] + size[at]] == self.names[k][j[at] + size[at]]
            size[at[same]] += 1 << k
        return size

    def backward(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many words before i and j are equal, ``limit`` at most."""
        size = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            at = np.flatnonzero(size + (1 << k) <= limit)
            back = size[at] + (1 << k)
            same = self.names[k][i[at] - back] == self.names[k][j[at] - back]
            size[at[same]] += 1 << k
        return size


def find_runs(text: np.ndarray, walls: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, period) of all runs of a text of ids whose ``walls`` stand between documents."""
    none = np.zeros(0, np.int64)
    if not len(text):
        return none, none, none
    grammar, repeats = Grammar(text, walls), Repeats(text)
    lo, mid, hi = (np.concatenate([none, *x]) for x in (grammar.start, grammar.middle, grammar.stop))
    rule, start, stop, period = _crossing(text, repeats, lo, mid, hi, least)
    # to all places where the nonterminal is derived
    by, place = np.concatenate([none, *grammar.rule]), np.concatenate([none, *grammar.place])
    used = np.isin(by, rule)
    by, place = by[used], place[used]
    order = np.argsort(by, kind="stable")
    by, place = by[order], place[order]
    first, last = np.searchsorted(by, rule, "left"), np.searchsorted(by, rule, "right")
    many = last - first
    which = np.repeat(np.arange(len(rule)), many)
    shift = place[_spread(first, many)] - lo[rule[which]]
    return _merged(start[which] + shift, stop[which] + shift, period[which], len(text))


def _spread(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each stretch, one stretch after the other."""
    total = int(many.sum())
    return np.arange(total) + np.repeat(first - (np.cumsum(many) - many), many)


def _crossing(text, repeats: Repeats, lo, mid, hi, least: int) -> tuple[np.ndarray, ...]:
    """(rule, start, stop, period) of runs inside each rule's occurrence that cross its boundary."""
    found: list[tuple[np.ndarray, ...]] = []
    large = np.flatnonzero(hi - lo >= least)
    todo = (hi - lo)[large] // 2  # periods to test
    ends = np.cumsum(todo)
    at = 0
    while at < len(large):
        # as many rules as fit the chunk; one with more periods is tested in parts
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
        rules = large[at:stop]
        for low in range(0, int(todo[at:stop].max()), CHUNK):
            many = np.clip(todo[at:stop] - low, 0, CHUNK)
            rule = np.repeat(rules, many)
            q = _spread(np.full(len(rules), low + 1), many)
            for side in (0, 1):
                # a run of period q across m has the word at m again at m - q or at m + q
                i = mid[rule] - q if side == 0 else mid[rule]
                inside = np.flatnonzero((i >= lo[rule]) & (i + q < hi[rule]))
                inside = inside[text[i[inside]] == text[i[inside] + q[inside]]]
                r, p, i = rule[inside], q[inside], i[inside]
                ahead = repeats.forward(i, i + p, hi[r] - i - p)
                behind = repeats.backward(i, i + p, i - lo[r])
                chain = ahead + behind
                good = (chain >= p) & (chain + p >= least)
                found.append((r[good], (i - behind)[good], (i + ahead + p)[good], p[good]))
        at = stop
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    rule, start, stop, period = (np.concatenate(x) for x in zip(*found, strict=True))
    # the same interval with several periods: multiples of the smallest one
    order = np.lexsort((period, stop, start, rule))
    rule, start, stop, period = (a[order] for a in (rule, start, stop, period))
    new = np.r_[True, (rule[1:] != rule[:-1]) | (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])][: len(rule)]
    return rule[new], start[new], stop[new], period[new]


def _merged(start: np.ndarray, stop: np.ndarray, period: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Without the intervals that lie in another one of their period."""
    if not len(start):
        return start, stop, period
    order = np.lexsort((-stop, start, period))
    start, stop, period = start[order], stop[order], period[order]
    reach = period * (n + 1) + stop  # the order of periods keeps their intervals apart
    before = np.r_[-1, np.maximum.accumulate(reach)[:-1]]
    keep = reach > before
    return start[keep], stop[keep], period[keep]


# ---- the query's texts ---------------------------------------------------------------


def extend_periodically(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) where one document in ten goes on periodically from some word to its end.

    With h the CRC-32 of the decimal id (empty for a null one) and g = h div 10: if 10 divides
    h and there are n > 0 words, each word i from a = g mod n on becomes word a + (i - a) mod p of
    the original, p = 1 + (n - a) div (3 + g mod 8). Other texts stay, null ones are empty.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / F.lit(10)).cast("long")

    def extended(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.pmod(g, n)
        p = F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8)))).cast("long") + 1

        def joined(s: Column) -> Column:
            at = lambda i: F.when(i < s["a"], i).otherwise(s["a"] + F.pmod(i - s["a"], s["p"])).cast("int")
            return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, at(i))), " ")

        return F.when(F.size(words) > 0, bind(F.struct(a.alias("a"), p.alias("p")), joined)).otherwise(F.col("text"))

    chosen = bind(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), extended)
    return rows.select("doc_id", F.when(F.pmod(h, F.lit(10)) == 0, chosen).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of rows of :func:`periodic_runs`.

    The named run is the longest; ties go to the smallest start, then period; without runs
    its columns are null.
    """
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    text = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    told = found.withColumn("_b", best)
    return told.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_b.s")).alias("start"),
        F.col("_b.l").alias("length"),
        (-F.col("_b.p")).alias("period"),
        F.floor(F.lit(1000) * F.col("_b.l") / -F.col("_b.p")).cast("long").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
