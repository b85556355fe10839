"""Chat formatting by schema fingerprints.

A record's nested field paths (list positions left out, sorted) are hashed; the hash selects a declarative mapping that
turns the record into canonical turns. Layouts: message lists under several names, prompt and completion, instruction
with input and output. A layout fits where its paths are among the record's; of several the one with most paths, then the
first listed; a hash that was not seen before is resolved so once and then looked up. Fields that the layout does not use
are returned as `extra`. The template marks turns and inserts one backslash after the < of every control string inside a
text, which reading back removes.

Defined results: null text or role is empty; turns are ordered by turn number (nulls first), ties by role, then text;
a record of no known layout, malformed JSON included, is kept as one turn of the role "record" that holds its text, with
layout "unknown"; a null record is an empty one; texts that are no strings are written as JSON; an empty table gives no
rows; extra columns are ignored; repeated rows are turns of their own.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

START, STOP = "<|im_start|>", "<|im_end|>"
Turn = tuple[str, str]


def field_paths(value, at: str = "") -> Iterator[str]:
    if isinstance(value, dict):
        for k, v in value.items():
            yield from field_paths(v, f"{at}.{k}" if at else str(k))
    elif isinstance(value, list):
        if not value:
            yield f"{at}[]"
        for v in value:
            yield from field_paths(v, f"{at}[]")
    else:
        yield at


def fingerprint(paths) -> str:
    return hashlib.sha1("\n".join(sorted(set(paths))).encode()).hexdigest()


#: name, field paths, and the turns: a list path with its role and text fields, or (role, fields joined by a blank line).
LAYOUTS = [
    ("messages", ("messages[].role", "messages[].content"), {"list": "messages", "role": "role", "text": "content"}),
    ("turns", ("turns[].role", "turns[].text"), {"list": "turns", "role": "role", "text": "text"}),
    ("conversations", ("conversations[].from", "conversations[].value"), {"list": "conversations", "role": "from", "text": "value"}),
    ("no_messages", ("messages[]",), {"list": "messages", "role": "role", "text": "content"}),
    ("prompt_completion", ("prompt", "completion"), {"turns": [("user", ["prompt"]), ("assistant", ["completion"])]}),
    ("prompt_response", ("prompt", "response"), {"turns": [("user", ["prompt"]), ("assistant", ["response"])]}),
    ("system_prompt_response", ("system", "prompt", "response"), {"turns": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["response"])]}),
    ("instruction", ("instruction", "output"), {"turns": [("user", ["instruction"]), ("assistant", ["output"])]}),
    ("instruction_input", ("instruction", "input", "output"), {"turns": [("user", ["instruction", "input"]), ("assistant", ["output"])]}),
    ("question_answer", ("question", "answer"), {"turns": [("user", ["question"]), ("assistant", ["answer"])]}),
]
MAPPINGS = {fingerprint(paths): (name, mapping) for name, paths, mapping in LAYOUTS}
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: Fingerprints that a worker remembers besides those of the layouts.
SEEN = 10_000
_resolved: dict[str, tuple] = {}


def selected(paths: set[str]) -> tuple:
    """(name, mapping) for a record's field paths; mapping None: no layout fits."""
    key = fingerprint(paths)
    if key in MAPPINGS:
        return MAPPINGS[key]
    if key not in _resolved:
        fits = [x for x in LAYOUTS if paths.issuperset(x[1])]
        if len(_resolved) >= SEEN:
            _resolved.clear()
        best = max(fits, key=lambda x: len(x[1]), default=None)
        _resolved[key] = (best[0], best[2]) if best else ("unknown", None)
    return _resolved[key]


def said(value) -> str:
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


def canonical_turns(record: dict) -> tuple[str, list[Turn], dict]:
    """(layout, turns, fields not used). Foreign role names of from/value lists are mapped to the usual ones. The turns of
    an unknown layout are None."""
    name, mapping = selected(set(field_paths(record)))
    if mapping is None:
        return name, None, {}
    if "list" in mapping:
        role, text = mapping["role"], mapping["text"]
        items = record[mapping["list"]]
        turns = [(said(x.get(role)), said(x.get(text))) if isinstance(x, dict) else ("", said(x)) for x in items]
        extra = {k: v for k, v in record.items() if k != mapping["list"]}
        own = [{k: v for k, v in x.items() if k not in (role, text)} if isinstance(x, dict) else {} for x in items]
        if any(own):
            extra[mapping["list"]] = own
        return name, [(ROLES.get(r, r), t) for r, t in turns] if name == "conversations" else turns, extra
    used = {f for _, fields in mapping["turns"] for f in fields}
    extra = {k: v for k, v in record.items() if k not in used}
    return name, [(role, "\n\n".join(said(record[f]) for f in fields if record[f])) for role, fields in mapping["turns"]], extra


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _role_line(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _line_role(line: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(line))


def format_turns(turns: list[Turn]) -> tuple[str, list[tuple[int, int]]]:
    """The training text and the loss mask: the spans of assistant texts, in code points, marks not included."""
    out, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{_role_line(role)}\n", escape(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, STOP, "\n"]
        at += len(head) + len(body) + len(STOP) + 1
    return "".join(out), mask


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(STOP) + r"\n", re.S)


def parse(formatted: str) -> list[Turn]:
    return [(_line_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


OUT = "conv_id long, layout string, formatted string, mask array<struct<start: long, end: long>>, extra string"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, layout string"


def read_record(raw: str | None) -> tuple[str, list[Turn], dict]:
    try:
        record = json.loads(raw) if raw else {}
    except (ValueError, RecursionError):
        record = None
    layout, turns, extra = canonical_turns(record) if isinstance(record, dict) else ("unknown", None, {})
    return layout, [("record", raw or "")] if turns is None else turns, extra


def format_records(records: DataFrame) -> DataFrame:
    """From (conv_id, record: JSON text): layout, formatted text, loss mask and the unused fields as JSON (null for none)."""

    def kernel(batches):
        for batch in small_batches(batches):
            layouts, texts, masks, extras = [], [], [], []
            for raw in batch.column(1).to_pylist():
                layout, turns, extra = read_record(raw)
                text, mask = format_turns(turns)
                layouts.append(layout)
                texts.append(text)
                masks.append([{"start": a, "end": b} for a, b in mask])
                extras.append(json.dumps(extra, ensure_ascii=False) if extra else None)
            span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
            columns = [batch.column(0), pa.array(layouts, pa.string()), pa.array(texts, pa.string()), pa.array(masks, pa.list_(span)), pa.array(extras, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "layout", "formatted", "mask", "extra"])

    return records.select("conv_id", "record").mapInArrow(kernel, OUT)


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted texts say when they are read back."""

    def kernel(batches):
        for batch in small_batches(batches):
            rows = []
            for conv, layout, text, mask in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[m["start"] : m["end"]]) for m in mask)
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text), layout))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in DIGEST.split(", ")])

    return formatted.select("conv_id", "layout", "formatted", "mask").mapInArrow(kernel, DIGEST)


def records_of(conversations: DataFrame) -> DataFrame:
    """One record (conv_id, record) for each conversation, in the plainest layout that holds it: prompt and response, these
    with a system text, or a message list. A conversation is one text in the end, so its turns meet."""
    turns = conversations.select("conv_id", F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("one"))
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("rows"))
    text = lambda i: F.col("rows")[i]["text"]
    roles = lambda *names: F.transform("rows", lambda x: x["role"]) == F.array(*map(F.lit, names))
    pair = F.to_json(F.struct(text(0).alias("prompt"), F.get("rows", F.lit(1))["text"].alias("response")))
    three = F.to_json(F.struct(text(0).alias("system"), F.get("rows", F.lit(1))["text"].alias("prompt"), F.get("rows", F.lit(2))["text"].alias("response")))
    listed = F.to_json(F.struct(F.transform("rows", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages")))
    return rows.select("conv_id", F.when(roles("user", "assistant"), pair).when(roles("system", "user", "assistant"), three).otherwise(listed).alias("record"))


def chat(conversations: DataFrame) -> DataFrame:
    return digests(format_records(records_of(conversations)))
