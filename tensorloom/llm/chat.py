"""Chat formatting with schema fingerprints.

Records come in many layouts: prompt/response, instruction/input/output, lists of messages
with differing field names. A layout is recognised by a hash of its nested field paths,
which selects a declarative mapping to canonical turns. Turns are rendered with a template
whose control strings are escaped inside texts, reversibly, and read back from the output.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain, groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BEGIN, HEAD, TAIL, END = "<s>", "[INST]", "[/INST]", "</s>"
#: anything that looks like a control string of common chat templates is escaped
_LEFT, _RIGHT = r"</?|\[/?|<</?|<\|", r"s>|INST\]|SYS>>|(?:im_start|im_end|end|endoftext|system|user|assistant)\|>"
_ESCAPE = re.compile(rf"({_LEFT})(\\*)({_RIGHT})")
_UNESCAPE = re.compile(rf"({_LEFT})\\(\\*)({_RIGHT})")

#: name -> (field paths, rule). A rule is a list of (role, path) or, for lists of messages,
#: (list path, role field, text field, role names).
LAYOUTS: dict[str, tuple[tuple[str, ...], object]] = {
    "prompt": (("prompt", "response"), [("user", "prompt"), ("assistant", "response")]),
    "completion": (("completion", "prompt"), [("user", "prompt"), ("assistant", "completion")]),
    "question": (("answer", "question"), [("user", "question"), ("assistant", "answer")]),
    "instruction": (("instruction", "output"), [("user", "instruction"), ("assistant", "output")]),
    "instruction_input": (
        ("input", "instruction", "output"),
        [("user", ("instruction", "input")), ("assistant", "output")],
    ),
    "system_instruction": (
        ("instruction", "output", "system"),
        [("system", "system"), ("user", "instruction"), ("assistant", "output")],
    ),
    "messages": (("messages[].content", "messages[].role"), ("messages", "role", "content", {})),
    "conversations": (
        ("conversations[].from", "conversations[].value"),
        ("conversations", "from", "value", {"human": "user", "gpt": "assistant"}),
    ),
    "turns": (("turns[].speaker", "turns[].text"), ("turns", "speaker", "text", {})),
}


def field_paths(value: object, prefix: str = "") -> set[str]:
    """Nested field paths; list elements share one path, so the layout doesn't depend on lengths."""
    if isinstance(value, dict):
        return set().union(*[field_paths(v, f"{prefix}.{k}" if prefix else k) for k, v in value.items()]) if value else {prefix}
    if isinstance(value, list):
        return set().union(*[field_paths(v, f"{prefix}[]") for v in value]) if value else {f"{prefix}[]"}
    return {prefix}


def fingerprint(paths: set[str] | tuple[str, ...]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


MAPPINGS = {fingerprint(paths): (name, rule) for name, (paths, rule) in LAYOUTS.items()}


def _found(record: object, path: str) -> str:
    value = record.get(path) if isinstance(record, dict) else None
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def canonical_turns(record: object) -> tuple[str, list[tuple[str, str]] | None]:
    """(fingerprint, turns); turns are None when no mapping has this fingerprint."""
    print_ = fingerprint(field_paths(record))
    _, rule = MAPPINGS.get(print_, (None, None))
    if rule is None:
        return print_, None
    if isinstance(rule, tuple):
        top, role, text, names = rule
        return print_, [(names.get(_found(m, role), _found(m, role)), _found(m, text)) for m in record[top]]
    join = lambda path: _found(record, path) if isinstance(path, str) else "\n\n".join(x for x in (_found(record, p) for p in path) if x)
    return print_, [(role, join(path)) for role, path in rule]


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of it that count for the loss: assistant texts."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"{BEGIN}{HEAD}{escape(role)}{TAIL}", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(BEGIN + HEAD, at):
            raise ValueError(f"no turn at {at}")
        at += len(BEGIN + HEAD)
        middle = formatted.index(TAIL, at)
        stop = formatted.index(END, middle + len(TAIL))
        turns.append((unescape(formatted[at:middle]), unescape(formatted[middle + len(TAIL) : stop])))
        at = stop + len(END)
    return turns


FORMATTED = "fingerprint string, mapping string, n_turns long, formatted string, loss array<struct<start:long,end:long>>"


def format_records(records: DataFrame, record_col: str = "record") -> DataFrame:
    """``records`` with (fingerprint, mapping, n_turns, formatted, loss) in place of the JSON ``record_col``.

    Records of an unknown layout, null ones and broken JSON keep their row with null
    ``mapping``, ``formatted`` and ``loss``; the fingerprint tells which mapping is missing
    (null for broken JSON). Columns of these names are replaced, others and repeats stay.
    """
    mine = StructType.fromDDL(FORMATTED)
    others = [c for c in records.columns if c not in (record_col, *mine.names)]
    shape = StructType([*records.select(*others).schema.fields, *mine.fields])
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_formatted(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], shape.names)

    return records.select(*others, record_col).mapInArrow(work, shape)


def _formatted(record: str | None) -> tuple:
    try:
        value = json.loads(record) if record is not None else None
    except ValueError:
        value = None
    if value is None:
        return None, None, 0, None, None
    print_, turns = canonical_turns(value)
    if turns is None:
        return print_, None, 0, None, None
    formatted, spans = render(turns)
    return print_, MAPPINGS[print_][0], len(turns), formatted, [{"start": a, "end": b} for a, b in spans]


#: rows and code points that end an Arrow batch of slices
SLICE_ROWS, SLICE_CHARS = 1000, 4_000_000


def slice_records(rows: DataFrame, *, id_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """(conv_id, slice, record): the records of :func:`gather_records` in slices, in order within a partition.

    Records of two or three turns are one slice. A list of messages has a slice per turn, a
    list of one: the layout's fingerprint doesn't depend on the length. A conversation lies in
    one partition, sorted by Spark, and four of its turns at most are held at once.
    """
    clean = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = rows.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), clean(role_col).alias("role"), clean(text_col).alias("text"))
    placed = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    shape = StructType([*turns.select("conv_id").schema.fields, *StructType.fromDDL("slice long, record string").fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        turns = (tuple(x.as_py() for x in row) for batch in chain([first], batches) for row in zip(*batch.columns, strict=True))
        types = (first.schema.types[0], pa.int64(), pa.string())
        for found in _bounded(_slices(turns)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], shape.names)

    return placed.select("conv_id", "role", "text").mapInArrow(work, shape)


def _slices(turns: Iterator[tuple]) -> Iterator[tuple]:
    """(id, number, record as JSON) of sorted turns (id, role, text)."""
    shown = lambda record: json.dumps(record, ensure_ascii=False)
    message = lambda turn: shown({"messages": [{"role": turn[1], "content": turn[2]}]})
    for conv, own in groupby(turns, key=lambda turn: turn[0]):
        head = list(islice(own, 4))
        roles, texts = [t[1] for t in head], [t[2] for t in head]
        if roles == ["user", "assistant"]:
            yield conv, 0, shown(dict(zip(("prompt", "response"), texts, strict=True)))
        elif roles == ["system", "user", "assistant"]:
            yield conv, 0, shown(dict(zip(("system", "instruction", "output"), texts, strict=True)))
        else:
            for k, turn in enumerate(chain(head, own)):
                yield conv, k, message(turn)


def _bounded(slices: Iterator[tuple]) -> Iterator[list[tuple]]:
    held, size = [], 0
    for row in slices:
        held.append(row)
        size += len(row[2])
        if len(held) >= SLICE_ROWS or size >= SLICE_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


READ = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Digests of what the formatted text and its loss mask say, per conversation.

    Rows without a formatted text have no turns and digests of nothing.
    """
    shape = StructType([*formatted.select(id_col).schema.fields, *StructType.fromDDL(READ).fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text, spans = text or "", spans or []
                turns = parse(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                told = "".join(f"{role}\n{body}\n" for role, body in turns)
                out.append((len(turns), _sha(told), len(loss), _sha(loss), len(text)))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], shape.names)

    return formatted.select(id_col, "formatted", "loss").mapInArrow(work, shape)


def read_slices(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """:func:`read_back` of conversations in formatted slices, as :func:`slice_records` numbers and places them.

    Digests grow slice by slice; slices out of place are an error.
    """
    shape = StructType([*formatted.select(id_col).schema.fields, *StructType.fromDDL(READ).fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        slices = (tuple(x.as_py() for x in row) for batch in chain([first], batches) for row in zip(*batch.columns, strict=True))
        types = (first.schema.types[0], pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        conversations = (_digests(conv, own) for conv, own in groupby(slices, key=lambda row: row[0]))
        while out := list(islice(conversations, SLICE_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], shape.names)

    return formatted.select(id_col, "slice", "formatted", "loss").mapInArrow(work, shape)


def _digests(conv: object, slices: Iterator[tuple]) -> tuple:
    told, loss = hashlib.sha256(), hashlib.sha256()
    n_turns = loss_chars = formatted_chars = 0
    for k, (_, number, text, spans) in enumerate(slices):
        if number != k:
            raise ValueError(f"slice {number} of {conv} in place of {k}")
        text = text or ""
        for role, body in parse(text):
            told.update(_bytes(f"{role}\n{body}\n"))
            n_turns += 1
        for s in spans or []:
            part = unescape(text[s["start"] : s["end"]])
            loss.update(_bytes(part))
            loss_chars += len(part)
        formatted_chars += len(text)
    return conv, n_turns, told.hexdigest(), loss_chars, loss.hexdigest(), formatted_chars


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _sha(text: str) -> str:
    return hashlib.sha256(_bytes(text)).hexdigest()


def gather_records(rows: DataFrame, *, id_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """(conv_id, record): one JSON record per conversation, in the layout its shape suggests.

    A user and an assistant turn make a prompt record, a system turn before them an
    instruction record, anything else a list of messages. Turns are ordered by number,
    then role and text; null texts and roles are empty. One conversation is one record, so
    it has to fit a task; :func:`slice_records` has no such limit.
    """
    clean = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct(F.col(turn_col).alias("turn"), clean(role_col).alias("role"), clean(text_col).alias("text"))
    held = rows.groupBy(F.col(id_col).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("t"))
    roles = F.array_join(F.transform("t", lambda x: F.regexp_replace(x["role"], ",", ";")), ",")
    said = lambda k: F.get("t", F.lit(k))["text"]
    options = {"ignoreNullFields": "false"}
    as_json = lambda *pairs: F.to_json(F.struct(*[v.alias(k) for k, v in pairs]), options)
    messages: Column = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    record = (
        F.when(roles == "user,assistant", as_json(("prompt", said(0)), ("response", said(1))))
        .when(roles == "system,user,assistant", as_json(("system", said(0)), ("instruction", said(1)), ("output", said(2))))
        .otherwise(as_json(("messages", messages)))
    )
    return held.select("conv_id", record.alias("record"))
