"""Chat formatting: schema fingerprints choose the mapping that turns a record into canonical turns.

Records arrive as JSON in whatever layout their source uses. The fingerprint of a record hashes its
sorted field paths (`messages[].role`), less those that are declared to say nothing of the turns (`IGNORED`), so
records of one layout share it whatever they say; it selects a declarative mapping, a plain table of paths, and no
code is written for a layout. Mappings may be added by the caller. A record whose fingerprint no mapping knows comes
back as one row without a role, with its fingerprint, and is never dropped in silence; `unmapped` counts them.

Formatting writes `<|im_start|>role\\n`, the text and `<|im_end|>\\n` for each turn. Inside roles and texts
every character that can begin a control string, and the escape character itself, is escaped
reversibly, so no text can open, close or imitate a turn. The loss mask of a turn is the span of its
escaped text if the role is `assistant`. A conversation is the turns' pieces in order, one row each, so
the longest one streams through a task in bounded memory and formatting needs no group at all.

Nulls: a null or empty text is empty; a null role is an empty one; null turns come first and a null
conversation is one of its own. Turns that share a number are ordered by role and text; repeated rows
stay. An unreadable record has the fingerprint of an empty one. Empty tables give empty results. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: What control strings of common templates begin with, the line end after a role, and the escape itself.
ESCAPES = {"\\": "\\\\", "<": "\\l", "[": "\\b", "\n": "\\n"}
_PLAIN = {v: k for k, v in ESCAPES.items()}
_ESCAPED = re.compile(r"\\.", re.S)
_PIECE = re.compile(re.escape(OPEN) + r"([^\n]*)\n([^\n]*)" + re.escape(CLOSE) + r"\n", re.S)


def paths(value, prefix: str = "") -> set[str]:
    """Field paths of a record; the elements of a list share one path."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{prefix}.{k}" if prefix else k) for k, v in value.items())) if value else set()
    if isinstance(value, list):
        return set().union({f"{prefix}[]"} if not value else set(), *(paths(v, f"{prefix}[]") for v in value))
    return {prefix} if prefix else set()


def fingerprint(fields) -> str:
    return hashlib.sha256("\n".join(sorted(fields)).encode("utf-8")).hexdigest()[:16]


#: Fields that describe a record or a turn without being part of what is said, at any depth.
IGNORED = frozenset(
    "id _id uid uuid name index idx source origin dataset split lang language model created created_at timestamp date meta metadata "
    "tags tag category topic score rating weight license url hash num_turns turn_id message_id parent_id conversation_id".split()
)

#: A layout: the paths it has, and how each of its turns is found. `each` names a list of turns with the
#: path of the role in it and the ways its text may be given (a path, then what else comes with it); `roles` says what it calls
#: the canonical ones, `before` which fields outside the list make turns before it. `turns` lists fixed roles with their
#: paths, whose texts are put together with a blank line. Fields outside `need` may be absent; every variant has its own fingerprint.
_SAID = (("content",), ("content[].text", "content[].type"), ("content[].text",), ("content[]",))
_SYSTEM = (("system", "system"),)
LAYOUTS = (
    {"each": "messages", "role": "role", "text": _SAID, "before": _SYSTEM},
    {"each": "conversations", "role": "from", "text": (("value",),), "roles": {"human": "user", "gpt": "assistant"}, "before": _SYSTEM},
    {"each": "dialog", "role": "speaker.kind", "text": (("body.text",),)},
    {"turns": (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))},
    {"turns": (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), "need": ("response",)},
    {"turns": (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))},
    {"turns": (("user", ("question.text",)), ("assistant", ("answer.text",)))},
    {"turns": (("system", ("system",)), ("user", ("question",)), ("assistant", ("answer",)))},
    {"role": "role", "text": (("text",),)},
)


def _subsets(items: tuple, least: int) -> Iterator[tuple]:
    return itertools.chain.from_iterable(itertools.combinations(items, k) for k in range(least, len(items) + 1))


def variants(layout: dict) -> Iterator[tuple[str, dict]]:
    """Fingerprints of a layout, each with the layout."""
    if "turns" in layout:
        optional = tuple(p for _, fields in layout["turns"] for p in fields if p not in layout.get("need", ()))
        for some in _subsets(optional, 0 if "need" in layout else 1):
            yield fingerprint({*some, *layout.get("need", ())}), layout
        return
    base = f"{layout['each']}[]." if "each" in layout else ""
    for ways in _subsets(layout["text"], 1):
        for before in _subsets(layout.get("before", ()), 0):
            said = {f"{base}{p}" for way in ways for p in way}
            yield fingerprint({base + layout["role"], *said, *(path for _, path in before)}), layout


MAPPINGS = {key: mapping for layout in LAYOUTS for key, mapping in variants(layout)}


def telling(fields: set[str]) -> set[str]:
    """Paths without those of ignored fields."""
    return {p for p in fields if not any(part.removesuffix("[]") in IGNORED for part in p.split("."))}


def _leaves(value, path: list[str]) -> Iterator:
    """The values at a path, in order; where the record has a list or an object instead, none."""
    if not path:
        if not isinstance(value, (dict, list)):
            yield value
    elif path[0].endswith("[]"):
        rows = value.get(path[0][:-2]) if isinstance(value, dict) else None
        for row in rows if isinstance(rows, list) else ():
            yield from _leaves(row, path[1:])
    elif isinstance(value, dict) and path[0] in value:
        yield from _leaves(value[path[0]], path[1:])


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _said(record, path: str) -> str:
    return "".join(map(_text, _leaves(record, path.split("."))))


def turns_of(record, mapping: dict) -> list[tuple[str, str]]:
    """(role, text) of each turn of a record."""
    if "turns" in mapping:
        there = paths(record)
        parts = ((role, [_said(record, p) for p in fields if p in there]) for role, fields in mapping["turns"])
        return [(role, "\n\n".join(t for t in texts if t)) for role, texts in parts if texts]
    rows = record[mapping["each"]] if "each" in mapping else [record]
    names = mapping.get("roles", {})
    ways = dict.fromkeys(way[0] for way in mapping["text"])
    found = ((_said(row, mapping["role"]), "".join(_said(row, path) for path in ways)) for row in rows)
    before = [(role, _said(record, path)) for role, path in mapping.get("before", ()) if path in record]
    return before + [(names.get(role, role), text) for role, text in found]


def unmapped(turns: DataFrame) -> DataFrame:
    """The fingerprints of `canonical_turns` that no mapping knows, and how many records have them."""
    return turns.where("role IS NULL").groupBy("fingerprint").agg(F.count(F.lit(1)).alias("records"))


def canonical_turns(records: DataFrame, json_col: str = "record", keys: tuple[str, ...] = ("conv_id", "turn"), mappings: dict | None = None) -> DataFrame:
    """The keys, `step` (place of the turn in its record), role, text and fingerprint of every turn."""
    known = MAPPINGS | (mappings or {})
    rows = records.select(*keys, F.col(json_col).cast("string").alias("record"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], ([], [], [], [])
            for row, raw in enumerate(batch.column("record").to_pylist()):
                try:
                    record = json.loads(raw or "{}")
                except ValueError:
                    record = {}
                key = fingerprint(telling(paths(record)))
                mapping = known.get(key)
                for step, (role, text) in enumerate(turns_of(record, mapping) if mapping else [(None, raw)]):
                    at.append(row)
                    for column, value in zip(out, (step, role, text, key)):
                        column.append(value)
            kept = [batch.column(n).take(pa.array(at, pa.int64())) for n in keys]
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [*kept, *(pa.array(v, k) for v, k in zip(out, kinds))], [*keys, "step", "role", "text", "fingerprint"]
            )

    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInArrow(run, f"{schema}, step long, role string, text string, fingerprint string")


def _escaped(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for plain, safe in ESCAPES.items():  # the escape character comes first
        out = F.replace(out, F.lit(plain), F.lit(safe))
    return out


def formatted(turns: DataFrame) -> DataFrame:
    """The piece of each turn with `loss_start` and `loss_end` in code points (equal: no loss)."""
    role, text = _escaped(F.col("role")), _escaped(F.col("text"))
    start = F.length(role) + len(OPEN) + 1
    end = F.when(F.col("role") == "assistant", start + F.length(text)).otherwise(start)
    return turns.withColumns(
        {"piece": F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE + "\n")), "loss_start": start, "loss_end": end}
    )


def plain(escaped: str) -> str:
    return _ESCAPED.sub(lambda m: _PLAIN[m[0]], escaped)


def parsed(piece: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    found = _PIECE.fullmatch(piece)
    if not found:
        raise ValueError("not a formatted turn")
    return plain(found[1]), plain(found[2])


def read_back(pieces: DataFrame) -> DataFrame:
    """Per conversation: turns and loss text, as counts and digests, read from the formatted pieces.

    A digest follows the order of the turns, so the pieces of a conversation pass one task one after
    another; it holds one batch of them and a hash state, however long the conversation is.
    """
    names = "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars".split()
    kind = pieces.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, arrow = None, pa.int64()

        def done() -> list:
            return [state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]]

        for batch in batches:
            arrow = batch.schema.field("conv_id").type
            out = []
            columns = (batch.column(n).to_pylist() for n in ("conv_id", "piece", "loss_start", "loss_end"))
            for conv, piece, start, end in zip(*columns):
                if state is None or state[0] != conv:
                    if state is not None:
                        out.append(done())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parsed(piece)
                loss = plain(piece[start:end])
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[3] += len(loss)
                state[4].update(loss.encode())
                state[5] += len(piece)
            yield _digest_rows(names, out, arrow)
        if state is not None:
            yield _digest_rows(names, [done()], arrow)

    order = ["conv_id", "turn", "step", "role", "text"]
    rows = pieces.repartition("conv_id").sortWithinPartitions(*order)
    return rows.select("conv_id", "piece", "loss_start", "loss_end").mapInArrow(
        run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def _digest_rows(names: list[str], rows: list[list], kind: pa.DataType) -> pa.RecordBatch:
    kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    columns = zip(*rows) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)
