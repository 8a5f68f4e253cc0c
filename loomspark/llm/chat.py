"""Chat formatting by schema fingerprints (operator 6).

A record's layout is the set of its nested field paths (`messages[].role`);
the hash of the sorted paths is its fingerprint, and a table from fingerprints
to declarative mappings turns prompt, instruction and message layouts into
canonical turns (role, text). A table's own schema is fingerprinted once, from
its columns; records kept as JSON strings one by one. Fields outside all known
layouts don't enter the hash, so extra fields and columns do no harm; where the
fields of several layouts stand side by side, the largest complete one counts;
a record of no known layout yields no turns and stays visible with its
fingerprint.

The template writes a turn as `### role: text</turn>` and a line end. In roles
and texts a backslash is put before every backslash, before each sign of a run
of three or more `#`, and before the `<` of `</turn>` (in roles also before a
colon), so no control string of a text can be taken for the template's, and
reading it back takes the backslashes away again. The loss mask covers exactly
the assistants' texts.

Turns are formatted where they are read; conversations are then dealt by id and
sorted by turn, and offsets run through each of them as a stream: no
conversation is gathered in memory.

Null roles and texts are empty; equal turn numbers are ordered by role and text
and repeated rows stay; a null turn comes first; a null id is a conversation of
its own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import record_batch, table

# --- layouts -----------------------------------------------------------------

ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}
#: Each mapping: list = (field, role field, text field), or turns = ((role, fields joined by a blank line), ...).
LAYOUTS = {
    "turn rows": {"paths": ("role", "text"), "row": ("role", "text")},
    "messages": {"paths": ("messages[].role", "messages[].content"), "list": ("messages", "role", "content")},
    "conversations": {"paths": ("conversations[].from", "conversations[].value"), "list": ("conversations", "from", "value")},
    "turns": {"paths": ("turns[].speaker", "turns[].text"), "list": ("turns", "speaker", "text")},
    "prompt completion": {"paths": ("prompt", "completion"), "turns": (("user", ("prompt",)), ("assistant", ("completion",)))},
    "prompt response": {"paths": ("prompt", "response"), "turns": (("user", ("prompt",)), ("assistant", ("response",)))},
    "system prompt response": {"paths": ("system", "prompt", "response"), "turns": (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))},
    "question answer": {"paths": ("question", "answer"), "turns": (("user", ("question",)), ("assistant", ("answer",)))},
    "instruction": {"paths": ("instruction", "output"), "turns": (("user", ("instruction",)), ("assistant", ("output",)))},
    "instruction input": {"paths": ("instruction", "input", "output"), "turns": (("user", ("instruction", "input")), ("assistant", ("output",)))},
}
KNOWN = {p for layout in LAYOUTS.values() for p in layout["paths"]}


def fingerprint(paths) -> str:
    """The hash of the field paths that some layout knows."""
    return f"{xxhash.xxh64_intdigest('\n'.join(sorted(KNOWN.intersection(paths)))):016x}"


MAPPINGS = {fingerprint(layout["paths"]): layout for layout in LAYOUTS.values()}


def layout_of(paths) -> dict | None:
    """The layout of the fingerprint; where fields of several layouts stand side
    by side, the one with the most of its own fields there (the first of equals)."""
    if (exact := MAPPINGS.get(fingerprint(paths))) is not None:
        return exact
    whole = [x for x in LAYOUTS.values() if set(x["paths"]) <= set(paths)]
    return max(whole, key=lambda x: len(x["paths"]), default=None)


def schema_paths(kind: T.DataType, at: str = "") -> set[str]:
    """The nested field paths of a schema."""
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, at + "[]")
    if isinstance(kind, T.StructType):
        return set().union(*(schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name) for f in kind.fields))
    return {at}


def record_paths(value, at: str = "") -> set[str]:
    """The nested field paths of a parsed JSON value; nulls and empty lists have none below them."""
    if isinstance(value, list):
        return set().union(*(record_paths(x, at + "[]") for x in value))
    if isinstance(value, dict):
        return set().union(*(record_paths(x, f"{at}.{k}" if at else k) for k, x in value.items()))
    return set() if value is None else {at}


def mapped(record: dict, layout: dict) -> list[tuple[str, str]]:
    """A record's canonical turns under a layout."""
    text = lambda x: x if isinstance(x, str) else "" if x is None else json.dumps(x, ensure_ascii=False)
    if "list" in layout:
        field, role, content = layout["list"]
        pairs = [(text(m.get(role)), text(m.get(content))) for m in record[field] if isinstance(m, dict)]
    elif "row" in layout:
        pairs = [tuple(text(record.get(f)) for f in layout["row"])]
    else:
        pairs = [(role, "\n\n".join(filter(None, (text(record.get(f)) for f in fields)))) for role, fields in layout["turns"]]
    return [(ROLES.get(r.lower(), r), t) for r, t in pairs]


def record_turns(records: DataFrame, id_column: str, json_column: str) -> DataFrame:
    """conv_id, turn, role, text, fingerprint of JSON records of mixed layouts,
    one row a turn; a record of no known layout has one row with null turn."""
    schema = T.StructType([T.StructField("conv_id", records.schema[id_column].dataType), *T.StructType.fromDDL("turn bigint, role string, text string, fingerprint string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, raw in zip(b.column("conv_id").to_pylist(), b.column("raw").to_pylist(), strict=True):
                try:
                    record = json.loads(raw or "null")
                except ValueError:
                    record = None
                paths = record_paths(record)
                print_ = fingerprint(paths)
                layout = layout_of(paths) if isinstance(record, dict) else None
                if layout is None:
                    rows.append((key, None, None, None, print_))
                else:
                    rows += [(key, k, role, text, print_) for k, (role, text) in enumerate(mapped(record, layout))]
            yield record_batch(rows, schema)

    source = records.select(F.col(id_column).alias("conv_id"), F.col(json_column).alias("raw"))
    return source.mapInArrow(run, schema)


def table_turns(rows: DataFrame, id_column: str = "conv_id", turn_column: str = "turn") -> DataFrame:
    """conv_id, turn, role, text of a table, by the mapping that its schema's
    fingerprint selects; ValueError if no layout fits."""
    layout = layout_of(schema_paths(rows.schema))
    if layout is None:
        raise ValueError(f"no layout for the fields {sorted(schema_paths(rows.schema))}")
    key, none = F.col(id_column).alias("conv_id"), F.lit("")
    if "row" in layout:
        role, text = layout["row"]
        return rows.select(key, F.col(turn_column).cast("long").alias("turn"), F.coalesce(role, none).alias("role"), F.coalesce(text, none).alias("text"))
    if "list" in layout:
        field, role, text = layout["list"]
        turns = rows.select(key, F.posexplode(field).alias("turn", "m"))
        pair = (F.col("m").getField(role), F.col("m").getField(text))
    else:
        made = F.array(*(F.struct(F.lit(r).alias("r"), F.concat_ws("\n\n", *(F.when(F.col(f) != "", F.col(f)) for f in fs)).alias("t")) for r, fs in layout["turns"]))
        turns = rows.select(key, F.posexplode(made).alias("turn", "m"))
        pair = (F.col("m.r"), F.col("m.t"))
    alias = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))
    role = F.coalesce(F.try_element_at(alias, F.lower(pair[0])), pair[0], none)
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), F.coalesce(pair[1], none).alias("text"))


# --- the template ------------------------------------------------------------

OPEN, CLOSE = "### ", "</turn>\n"
CONTROL = re.compile(r"\\|#{3,}|<(?=/turn>)")
ROLE_CONTROL = re.compile(r"\\|#{3,}|<(?=/turn>)|:")
ESCAPED = re.compile(r"\\(.)", re.S)
TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)


def escaped(text: str, control: re.Pattern = CONTROL) -> str:
    return control.sub(lambda m: "".join("\\" + c for c in m[0]), text)


def plain(text: str) -> str:
    return ESCAPED.sub(r"\1", text) if "\\" in text else text


def written(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where the text lies in it (start, length)."""
    head, body = f"{OPEN}{escaped(role, ROLE_CONTROL)}: ", escaped(text)
    return head + body + CLOSE, len(head), len(body)


class Reader:
    """Reads turns back from formatted text that comes in any pieces."""

    def __init__(self):
        self.buffer = ""

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        self.buffer += piece
        at = 0
        while m := TURN.match(self.buffer, at):
            at = m.end()
            yield plain(m[1]), plain(m[2])
        self.buffer = self.buffer[at:]


def formatted(turns: DataFrame) -> DataFrame:
    """One row a turn, in order inside each conversation: conv_id, turn,
    formatted, start (its offset in the conversation), loss_start, loss_length
    (the loss mask in the conversation; null outside assistants' turns).

    A conversation's formatted text is its rows' `formatted`, one after the
    other. Rows of a conversation are contiguous in one partition.
    """
    schema = T.StructType([T.StructField("conv_id", turns.schema["conv_id"].dataType)] + [T.StructField(n, k) for n, k in (("turn", T.LongType()), ("formatted", T.StringType()), ("start", T.LongType()), ("loss_start", T.LongType()), ("loss_length", T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = object(), 0
        for b in batches:
            rows = []
            for key, turn, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
                if key != now:
                    now, at = key, 0
                piece, first, length = written(role or "", text or "")
                loss = role == "assistant"
                rows.append((key, turn, piece, at, at + first if loss else None, length if loss else None))
                at += len(piece)
            yield record_batch(rows, schema)

    rows = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(run, schema)


def digests(pieces: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted rows: n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    schema = T.StructType([pieces.schema["conv_id"]] + [T.StructField(n, k) for n, k in (("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reader, state = object(), None, None

        def row() -> tuple:
            if reader.buffer:
                raise ValueError(f"formatted text of conversation {now} can't be read back")
            return now, state["n"], state["turns"].hexdigest(), state["loss"], state["sha"].hexdigest(), state["chars"]

        for b in batches:
            rows = []
            columns = (b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "start", "loss_length"))
            for key, piece, loss_start, start, length in zip(*columns, strict=True):
                if reader is None or key != now:
                    if reader is not None:
                        rows.append(row())
                    now, reader = key, Reader()
                    state = {"n": 0, "turns": hashlib.sha256(), "loss": 0, "sha": hashlib.sha256(), "chars": 0}
                state["chars"] += len(piece)
                for role, text in reader.feed(piece):
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{text}\n".encode())
                if loss_start is not None:
                    at = loss_start - start
                    text = plain(piece[at : at + length])
                    state["loss"] += len(text)
                    state["sha"].update(text.encode())
            if rows:
                yield record_batch(rows, schema)
        if reader is not None:
            yield record_batch([row()], schema)

    return pieces.mapInArrow(run, schema)


PROBE = "\\### Assistant: </turn> ok"


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations and of conversation -7, which is made of control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], rows.schema)
    return digests(formatted(table_turns(rows.unionByName(probe))))


OP6_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), f AS (
  SELECT *,
    length(text) + length(regexp_replace(text, '[^\\]', '', 'g')) + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x))), 0)
      + len(regexp_extract_all(text, '</turn>')) AS body,
    length(role) + length(regexp_replace(role, '[^\\:]', '', 'g')) + coalesce(list_sum(list_transform(regexp_extract_all(role, '#{3,}'), lambda x: length(x))), 0)
      + len(regexp_extract_all(role, '</turn>')) AS head FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || E'\n' || text || E'\n', '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(head + body + 14) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
