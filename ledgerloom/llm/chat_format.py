"""Chat formatting: a template is a black box; turns are located by rendering prefixes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Turns of a template that is declared additive rendered together; earlier ones it may look back at from inside a block.
BLOCK, LOOK_BACK = 16, 2
_PROBE = "\ue000"
_OPEN, _CLOSE = "<turn>", "</turn>"
_TURN = re.compile(
    r"<turn>((?:[^\\\n]++|\\.)*+)\n((?:[^\\<]++|\\.|<(?!/?turn>))*+)</turn>\n", re.S
)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace(_OPEN, "\\" + _OPEN).replace(_CLOSE, "\\" + _CLOSE)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def render(turns: list[tuple[str, str]]) -> str:
    """The built-in template: each turn between markers, its role on the first line."""
    return "".join(
        _OPEN + escape(role).replace("\n", "\\n") + "\n" + escape(text) + _CLOSE + "\n" for role, text in turns
    )


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text, read back from its markers."""
    out = []
    for m in _TURN.finditer(formatted):
        out.append((unescape(m[1]), unescape(m[2])))
    return out


def _locate(template, history: list, turn: tuple, before: str) -> tuple[str, int, str, int, int]:
    """(output, characters kept of ``before``, what the turn adds, its text's place in that)."""
    after = template([*history, turn])
    kept = len(before)
    if not after.startswith(before):
        kept = next((k for k, (x, y) in enumerate(zip(before, after, strict=False)) if x != y), min(len(before), len(after)))
    piece = after[kept:]
    probe = template([*history, (turn[0], _PROBE)])[kept:]
    head, found, tail = probe.partition(_PROBE)
    if not found or not piece.startswith(head) or not piece.endswith(tail) or len(piece) < len(head) + len(tail):
        return after, kept, piece, -1, -1
    return after, kept, piece, len(head), len(piece) - len(tail)


def _formatter(template: Callable, trained: str, block: int, look_back: int, additive: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv: object = None
        history: list = []
        state = {"at": 0, "chars": 0, "out": ""}
        begun = False
        for batch in batches:
            rows = []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "role", "text")]
            for conv_id, role, text in zip(*columns, strict=True):
                if not begun or conv_id != conv:
                    conv, begun, history = conv_id, True, []
                    state = {"at": 0, "chars": 0, "out": template([])}
                    head = state["out"]
                elif additive and len(history) >= block + look_back:
                    history = history[-look_back:] if look_back else []
                    state["out"], head = template(history), ""
                else:
                    head = ""
                turn = (role or "", text or "")
                before = state["out"]
                state["out"], kept, piece, start, stop = _locate(template, history, turn, before)
                rewrites = kept < len(before)
                piece, shift = head + piece, len(head)
                history.append(turn)
                at = state["chars"] - (len(before) - kept)
                loss = start >= 0 and role == trained
                rows.append(
                    (
                        conv_id, state["at"], role, piece, at, at + len(piece),
                        at + shift + start if loss else None, at + shift + stop if loss else None, rewrites,
                        start >= 0,
                    )
                )
                state["at"] += 1
                state["chars"] = at + len(piece)
            cols = list(zip(*rows, strict=True)) if rows else [()] * 10
            kinds = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 4, pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], FIELDS)

    return run


FIELDS = ["conv_id", "ordinal", "role", "piece", "start", "stop", "loss_start", "loss_stop", "rewrites", "located"]


def format_turns(
    rows: DataFrame, template: Callable = render, trained: str = "assistant", block: int = BLOCK, look_back: int = LOOK_BACK,
    additive: bool | None = None,
) -> DataFrame:
    """One row per turn of ``rows`` (``conv_id, turn, role, text``): what the turn adds to the output.

    ``piece`` is that addition, ``start`` and ``stop`` its span in the conversation's output, counted in code points,
    ``loss_start`` and ``loss_stop`` the span of its text if ``trained`` said it. ``template`` turns
    a list of (role, text) into a string and is only called: prefixes of growing length are rendered and each
    output is compared with the one before. Where it does not begin with the one before, the
    template rewrites history (``rewrites``) and the span starts at the first change. The text is found by rendering
    a probe in its place; where that fails ``located`` is false and there is no loss span.

    Every prefix is rendered whole, so a conversation's cost grows with the square of its length and its turns are held
    while it lasts. Only a template that is declared ``additive`` (the built-in one is) is rendered in blocks: it must
    render a turn from that turn and the ``look_back`` turns before alone. After ``block + look_back`` turns it then goes
    on in blocks of ``block`` turns, and cost and memory grow with a conversation's length. Rows stream through, sorted by turn (ties by role, text); conversations
    are taken one at a time. Null role and text are empty; rows without ``conv_id`` are one conversation; other
    columns are ignored.
    """
    additive = template is render if additive is None else additive
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = (
        f"conv_id {kind}, ordinal long, role string, piece string, start long, stop long, loss_start long, "
        "loss_stop long, rewrites boolean, located boolean"
    )
    return (
        rows.select("conv_id", "turn", "role", "text")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
        .mapInArrow(_formatter(template, trained, block, look_back, additive), schema)
    )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from the turns' output alone, which arrive in order."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    conv, live, kind = None, None, None

    def done():
        n, turns, chars, loss, size = live
        return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size

    def pack(rows):
        cols = list(zip(*rows, strict=True))
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    for batch in batches:
        kind, rows = batch.schema.field("conv_id").type, []
        for r in batch.to_pylist():
            if live is None or r["conv_id"] != conv:
                if live is not None:
                    rows.append(done())
                conv, live = r["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in parse(r["piece"]):
                live[0] += 1
                live[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if r["loss_start"] is not None:
                text = unescape(r["piece"][r["loss_start"] - r["start"] : r["loss_stop"] - r["start"]])
                live[2] += len(text)
                live[3].update(text.encode("utf-8", "surrogatepass"))
            live[4] += len(r["piece"])
        if rows:
            yield pack(rows)
    if live is not None:
        yield pack([done()])


def digests(turns: DataFrame) -> DataFrame:
    """Counts and digests per conversation, read back from the output of :func:`format_turns`."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return turns.mapInArrow(_digest, schema)
