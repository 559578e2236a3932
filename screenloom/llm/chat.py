"""Chat formatting: records of any known layout become canonical turns, then one marked-up text.

Records arrive as JSON. The nested field paths of a record (list levels as ``[]``, no values) are sorted
and hashed; the hash selects a declarative mapping from a registry, which says where the turns,
roles and texts lie. Fields that a layout does not name (an id, a score) do not hide it: if no mapping has the
hash of all paths, the one whose paths are all there decides, the one of most paths first. Roles of turn rows
are taken as they are; those of other layouts are mapped (``human`` is the user). One record may hold a
conversation, or one turn of it; turns of a conversation are brought together by a sort inside hash
partitions and streamed, so a conversation is never held as a group in memory but for its own text.

Template. Each turn is ``<|start|>role<|sep|>text<|end|>`` and a newline. Inside roles and texts the
escape character U+001B is doubled to ESC ``0``, and the first character of any control string, the
template's own and those of common other templates, is preceded by ESC ``1``; reading undoes both.
A text can so never open or close a turn, here or in a template that is laid over it.

Defined results. Null text is the empty text, a null role the empty role; a number, a truth value or a nested
value as text is its JSON; half of a surrogate pair, which no UTF-8 text can hold, becomes U+FFFD. Turns are in the order of ``turn`` (null first), ties in the order of role and
text; repeated rows are turns of their own. A conversation of no turns gives no row. A record that is null, no
JSON object or in no known layout gives no turn; ``problem`` then says why, and a conversation of such
records alone has a row without turns. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenloom.llm.common import map_batches

ESC = "\x1b"
START, SEP, END = "<|start|>", "<|sep|>", "<|end|>"
#: Control strings that must not be read as such when they stand in a text.
CONTROLS = [START, SEP, END, "<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|endoftext|>", "<|begin_of_text|>", "<|end_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>", "<|system|>", "<|user|>", "<|assistant|>", "<start_of_turn>", "<end_of_turn>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<bos>", "<eos>", "<pad>", "<unk>"]
_CONTROL = re.compile(f"{ESC}|{'|'.join(re.escape(c) for c in CONTROLS)}")
_ESCAPED = re.compile(f"{ESC}([01])")
#: What a turn adds besides its escaped role and text.
OVERHEAD = len(START) + len(SEP) + len(END) + 1


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{ESC}0" if m[0] == ESC else f"{ESC}1{m[0]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: ESC if m[1] == "0" else "", text)


def render(role: str, text: str) -> str:
    return f"{START}{escape(role)}{SEP}{escape(text)}{END}\n"


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of every turn; start and end of the escaped text in ``formatted``.

    The marks are looked for outside escapes: an escaped control string starts with ESC 1, so the
    plain mark that follows it is skipped.
    """
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn at {at}")
        sep = _find(formatted, SEP, at + len(START))
        end = _find(formatted, END, sep + len(SEP))
        turns.append((unescape(formatted[at + len(START) : sep]), unescape(formatted[sep + len(SEP) : end]), sep + len(SEP), end))
        at = end + len(END) + 1
    return turns


def _find(text: str, mark: str, at: int) -> int:
    while (at := text.index(mark, at)) >= 2 and text[at - 2 : at] == f"{ESC}1":
        at += len(mark)
    return at


# --- layouts --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Layout:
    """Where turns lie: ``turns`` names a list of records (or None: the record itself holds ``fields``)."""

    name: str
    turns: str | None = None
    role: str | None = None
    text: str | None = None
    fields: tuple[tuple[str, str], ...] = ()
    roles: tuple[tuple[str, str], ...] = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))


#: The known layouts: a sample of the fields that matter, and the mapping for it.
LAYOUTS: list[tuple[Any, Layout]] = [
    ({"turn": 0, "role": "", "text": ""}, Layout("turn rows", None, "role", "text", roles=())),
    ({"messages": [{"role": "", "content": ""}]}, Layout("messages", "messages", "role", "content")),
    ({"conversations": [{"from": "", "value": ""}]}, Layout("conversations", "conversations", "from", "value")),
    ({"instruction": "", "output": ""}, Layout("instruction", fields=(("user", "instruction"), ("assistant", "output")))),
    (
        {"instruction": "", "input": "", "output": ""},
        Layout("instruction with input", fields=(("user", "instruction\n\ninput"), ("assistant", "output"))),
    ),
    (
        {"system": "", "instruction": "", "input": "", "output": ""},
        Layout("system instruction", fields=(("system", "system"), ("user", "instruction\n\ninput"), ("assistant", "output"))),
    ),
    ({"prompt": "", "completion": ""}, Layout("prompt", fields=(("user", "prompt"), ("assistant", "completion")))),
    ({"prompt": "", "response": ""}, Layout("prompt response", fields=(("user", "prompt"), ("assistant", "response")))),
    ({"system": "", "prompt": "", "response": ""}, Layout("system prompt", fields=(("system", "system"), ("user", "prompt"), ("assistant", "response")))),
    ({"question": "", "answer": ""}, Layout("question", fields=(("user", "question"), ("assistant", "answer")))),
]


_SIGNS = re.compile(r'[.\[\]"]')
_HALF = re.compile("[\ud800-\udfff]")


def paths(value: Any, prefix: str = "") -> set[str]:
    """Nested field paths; the elements of a list share one. A name that holds a sign of paths is quoted."""
    if isinstance(value, Mapping):
        named = ((json.dumps(k) if _SIGNS.search(k) else k, v) for k, v in value.items())
        return {p for k, v in named for p in paths(v, f"{prefix}.{k}" if prefix else k)} or {prefix}
    if isinstance(value, list):
        return {p for v in value for p in paths(v, f"{prefix}[]")} or {f"{prefix}[]"}
    return {prefix}


def fingerprint(record: Any) -> str:
    """Hash of the sorted field paths."""
    return hashlib.sha256("\n".join(sorted(paths(record))).encode("utf-8", "surrogatepass")).hexdigest()


REGISTRY: dict[str, Layout] = {fingerprint(sample): mapping for sample, mapping in LAYOUTS}
KNOWN: list[tuple[frozenset[str], Layout]] = sorted(((frozenset(paths(x)), m) for x, m in LAYOUTS), key=lambda k: -len(k[0]))


def layout_of(record: Any, registry: Mapping[str, Layout] = REGISTRY, known: Sequence[tuple[frozenset[str], Layout]] = KNOWN) -> Layout | None:
    """The mapping for a record: by the hash of its paths, else the largest known layout whose paths it has."""
    found = registry.get(fingerprint(record))
    if found is None:
        own = paths(record)
        own |= {p[: m.start()] for p in own for m in re.finditer(r"\.|\[\]", p)}  # a nested value stands where a text may
        found = next((layout for needed, layout in known if needed <= own), None)
    return found


def _text(value: Any) -> str:
    """A value as text: null as the empty one, what is no text as JSON."""
    if value is None:
        return ""
    return _HALF.sub("\ufffd", value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True))


def canonical_turns(record: Any, registry: Mapping[str, Layout] = REGISTRY) -> list[tuple[str, str]]:
    """(role, text) of a record; ``ValueError`` names the paths of one in no known layout."""
    if not isinstance(record, Mapping):
        raise ValueError("no JSON object")
    layout = layout_of(record, registry)
    if layout is None and any(record.get(x.turns) == [] for x in registry.values() if x.turns):
        return []  # an empty list of turns has no paths inside
    if layout is None:
        raise ValueError(f"unknown layout: {_text(', '.join(sorted(paths(record))))}")
    if layout.fields:
        found = []
        for role, field in layout.fields:
            parts = [_text(record.get(f)) for f in field.split("\n\n")]
            if role != "system" or any(parts):
                found.append((role, "\n\n".join(p for p in parts if p)))
        return found
    roles = dict(layout.roles)
    turns = [t for t in record[layout.turns] if isinstance(t, Mapping)] if layout.turns else [record]
    return [(roles.get(r := _text(t.get(layout.role)), r), _text(t.get(layout.text))) for t in turns]


def turns_or_problem(text: str | None) -> tuple[list[tuple[str, str]], str | None]:
    """The turns of a record given as JSON, or why there are none."""
    if text is None:
        return [], "null record"
    try:
        return canonical_turns(json.loads(text)), None
    except RecursionError:
        return [], "nested too deeply"
    except ValueError as e:  # json.JSONDecodeError is one
        return [], "no JSON" if isinstance(e, json.JSONDecodeError) else str(e)


# --- the operator ---------------------------------------------------------------------------------


def turn_records(rows: DataFrame, id_col: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A table with one row per turn as (conv, turn, role, text, record): the record in the layout of turn rows."""
    fields = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    return rows.select(
        F.col(id_col).alias("conv"), F.col(turn).cast("long").alias("turn"), F.to_json(fields, {"ignoreNullFields": "false"}).alias("record")
    )


def format_chats(records: DataFrame, id_col: str = "conv_id", loss_roles: Sequence[str] = ("assistant",), with_text: bool = False) -> DataFrame:
    """(conv, turn, record JSON) -> per conversation what is read back from its formatted text.

    id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, problem (the first record's that gave no turn); with ``with_text`` also
    ``formatted`` and ``loss_spans`` (start and end of each text under the loss, escaped, alternating).
    """
    learned = frozenset(loss_roles)

    def finish(conv: Any, pieces: list[str], problem: str | None) -> tuple:
        formatted = "".join(pieces)
        every, loss, chars, spans = hashlib.sha256(), hashlib.sha256(), 0, []
        turns = parse(formatted)
        for role, text, start, end in turns:
            every.update(f"{role}\n{text}\n".encode())
            if role in learned:
                loss.update(text.encode())
                chars += len(text)
                spans += [start, end]
        out = (conv, len(turns), every.hexdigest(), chars, loss.hexdigest(), len(formatted), problem)
        return (*out, formatted, spans) if with_text else out

    columns = [id_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "problem"]
    columns += ["formatted", "loss_spans"] if with_text else []

    def stream(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, pieces, problem, started, kind = None, [], None, False, pa.null()

        def flush(done: list[tuple]) -> pa.RecordBatch:
            longs, text = pa.int64(), pa.string()
            kinds = [kind, longs, text, longs, text, longs, text, *([text, pa.list_(longs)] if with_text else [])]
            return pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=columns)

        for batch in it:
            kind, done = batch.schema.field("conv").type, []
            for key, record in zip(batch.column("conv").to_pylist(), batch.column("record").to_pylist(), strict=True):
                if started and key != conv:
                    if pieces or problem:
                        done.append(finish(conv, pieces, problem))
                    pieces, problem = [], None
                conv, started = key, True
                turns, why = turns_or_problem(record)
                pieces += [render(r, t) for r, t in turns]
                problem = problem or why
            if done:
                yield flush(done)
        if pieces or problem:
            yield flush([finish(conv, pieces, problem)])

    kind = records.schema["conv"].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, problem string"
    schema += ", formatted string, loss_spans array<long>" if with_text else ""
    role, text = F.get_json_object("record", "$.role"), F.get_json_object("record", "$.text")
    told = records.select("conv", "turn", "record").repartition("conv").sortWithinPartitions("conv", "turn", F.coalesce(role, F.lit("")), F.coalesce(text, F.lit("")))
    return map_batches(told, stream, schema)
