"""Chat formatting: logs of message events are folded to final messages, then rendered.

Events carry conv_id, message (place in the conversation), version (a regeneration has a higher
one), seq and kind: "start" (text is the role), "delta" (text is appended), "edit" (text takes the
place of all that came before in that version). Sorted by conversation, message, version and seq,
the events of a message stand together, so the fold holds one message at a time.
"""
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

OPEN, CLOSE = "<s>[INST]", "[/INST]</s>"
#: Control strings of the template (fixed values); inside a text each gets a backslash before its last character.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
_ESCAPE = re.compile(r"\\|" + "|".join(map(re.escape, CONTROL)))
_UNESCAPE = re.compile(r"\\(.)", re.S)
_TURN = re.compile(re.escape(OPEN) + r"((?:\\.|[^\\\n])*)\n(.*?)" + re.escape(CLOSE), re.S)
SEGMENTS = "conv_id bigint, turn bigint, role string, segment string, loss_from bigint, loss_to bigint"
DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][:-1] + "\\" + m[0][-1], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and the span of its loss mask (empty but for the assistant)."""
    head = OPEN + escape(role).replace("\n", "\\\n") + "\n"
    body = escape(text)
    start = len(head)
    return head + body + CLOSE, start, start + len(body) * (role == "assistant")


def read_turn(segment: str) -> tuple[str, str]:
    found = _TURN.fullmatch(segment)
    if not found:
        raise ValueError("not a rendered turn")
    return unescape(found[1]), unescape(found[2])


def message_events(rows: DataFrame) -> DataFrame:
    """A log of a table of whole messages (conv_id, turn, role, text), as a chat service would leave it.

    An assistant's message is a first answer that breaks off, and its regeneration in two deltas; any
    other message is a draft that an edit replaces by the text's first half, and a delta with the rest.
    A message's events come with the last one first, so only their sequence numbers give the order.

    Null roles and texts count as empty. Rows of one turn keep apart; they stand in the order of
    role and text, repeated rows next to each other. A null turn comes first.
    """
    clean = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    half = (F.length("text") / 2).cast("int")
    head, rest = F.substring(F.col("text"), F.lit(1), half), F.substring(F.col("text"), half + 1, F.length("text") - half)
    event = lambda v, n, kind, body: F.struct(F.lit(v).cast("bigint").alias("version"), F.lit(n).cast("bigint").alias("seq"), F.lit(kind).alias("kind"), body.alias("body"))
    draft = F.lit("a first try at this")
    answer = F.array(event(1, 4, "delta", rest), event(1, 3, "delta", head), event(1, 2, "start", F.col("role")), event(0, 1, "delta", draft), event(0, 0, "start", F.col("role")))
    other = F.array(event(0, 3, "delta", rest), event(0, 2, "edit", head), event(0, 1, "delta", draft), event(0, 0, "start", F.col("role")))
    numbered = clean.withColumn("row", F.monotonically_increasing_id())  # tells repeated rows apart
    return numbered.select("conv_id", F.col("turn").alias("message"), F.struct("role", "text").alias("tie"), "row", F.explode(F.when(F.col("role") == "assistant", answer).otherwise(other)).alias("e")).select("conv_id", "message", "tie", "row", "e.*")


def _fold(batches):
    """Sorted events to rendered turns; of a message's versions the last one counts."""
    at, version, role, parts, turn, conv = None, None, "", [], 0, ()
    rows: list = []
    names = ["conv_id", "turn", "role", "segment", "loss_from", "loss_to"]
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("segment", pa.string()), ("loss_from", pa.int64()), ("loss_to", pa.int64())])

    def close():
        nonlocal turn
        segment, lo, hi = render_turn(role, "".join(parts))
        rows.append((at[0], turn, role, segment, lo, hi))
        turn += 1

    def out():
        done = pa.RecordBatch.from_arrays([pa.array(c, schema.field(i).type) for i, c in enumerate(zip(*rows))], names)
        rows.clear()
        return done

    for batch in batches:
        for c, m, row, v, kind, body in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "message", "row", "version", "kind", "body"))):
            if at != (c, m, row):
                if at is not None:
                    close()
                if at is None or at[0] != c:
                    turn = 0
                at, version, role, parts = (c, m, row), v, "", []
            elif v != version:  # a regeneration takes the place of what was there
                version, parts = v, []
            if kind == "start":
                role = body or ""
            elif kind == "edit":
                parts = [body or ""]
            else:
                parts.append(body or "")
        if rows:
            yield out()
    if at is not None:
        close()
        yield out()


def render(events: DataFrame) -> DataFrame:
    """One row for each final message, in order within a partition: its formatted segment and loss span.

    A conversation's output is its segments joined by turn. events may lack tie and row (messages
    are then told apart by conv_id and message alone). Null conv_id rows form one conversation.
    """
    small_batches(events.sparkSession, 5000)
    for name in ("tie", "row"):
        if name not in events.columns:
            events = events.withColumn(name, F.lit(0).cast("bigint"))
    order = ["conv_id", "message", "tie", "row", "version", "seq"]
    return events.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "message", "row", "version", "kind", "body").mapInArrow(_fold, SEGMENTS)


def _digest(batches):
    conv, state = None, None

    def row():
        n, turns, chars, loss, formatted = state
        return pa.RecordBatch.from_pylist([{"conv_id": conv, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": formatted}], pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))

    for batch in batches:
        done = []
        for c, segment, lo, hi in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "segment", "loss_from", "loss_to"))):
            if state is None or c != conv:
                if state is not None:
                    done.append(row())
                conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = read_turn(segment)
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            masked = unescape(segment[lo:hi])
            state[2] += len(masked)
            state[3].update(masked.encode())
            state[4] += len(segment)
        yield from done
    if state is not None:
        yield row()


def digests(segments: DataFrame) -> DataFrame:
    """What render()'s segments say when read back, by conversation. The rows must come straight
    from render(): conversations stand whole and in order within a partition. A conversation is one row
    however long; it is hashed turn by turn, without holding it. No segments give no rows."""
    return segments.mapInArrow(_digest, DIGEST)
