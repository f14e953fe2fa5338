"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns to a string. Rendering successive prefixes and comparing consecutive
outputs locates the span of each turn; where an output isn't a prefix of the next one, the template rewrites history, which
is recorded with the turn. Where in its span the text of a turn lies is found the same way: two renderings of the turn
with different one-letter texts differ in the text only, so what they share on either side is the template's own.

A template whose attribute `local` is true says that it renders a turn from the last LOOKBACK turns before it and never
rewrites; TEMPLATE does. After the first FULL turns, which are checked, its turns are rendered with the last LOOKBACK turns
only, so long conversations cost time in proportion to their length and memory doesn't hold their turns; should it rewrite
all the same, that is an error. Any other template is rendered with all turns before each turn, however long the
conversation, and the conversation is one segment, since a later turn may still change all of it. Conversations arrive
sorted and are worked on turn by turn.

The template of the query, `TEMPLATE`, marks turns with bracketed control strings and escapes these inside texts with a
backslash, which is undone on reading.

Cases: null text and null role count as empty. Turns are ordered by turn, then role, then text; null turns come first.
Rows without conv_id form one conversation. Repeated rows are turns of their own. Other columns are not read. A table
without rows gives no conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorale.llm.common import read_table, tidy

#: Control strings of the template (fixed values).
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]"]
FULL, LOOKBACK, SEGMENT_TURNS = 48, 3, 256

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for c in CONTROLS:
        text = text.replace(c, c[0] + "\\" + c[1:])
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def TEMPLATE(turns: list[Turn]) -> str:
    out = []
    for role, text in turns:
        text = escape(text)
        if role == "user":
            out.append(f"<s>[INST] {text} [/INST]")
        elif role == "assistant":
            out.append(f" {text} </s>")
        elif role == "system":
            out.append(f"<s><<SYS>>{text}<</SYS>>")
        else:
            out.append(f"<s>[ROLE]{escape(role)}[/ROLE]{text}</s>")
    return "".join(out)


TEMPLATE.local = True

_TURN = re.compile(
    r"<s>\[INST\] (?P<user>.*?) \[/INST\]|<s><<SYS>>(?P<system>.*?)<</SYS>>|<s>\[ROLE\](?P<role>.*?)\[/ROLE\](?P<other>.*?)</s>| (?P<assistant>.*?) </s>", re.S
)


def parse(formatted: str) -> list[Turn]:
    """The turns that TEMPLATE made a string of."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        kind = m.lastgroup
        turns.append((unescape(m["role"]) if kind == "other" else kind, unescape(m[kind])))
        at = m.end()
    return turns


def shared_prefix(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def shared_suffix(a: str, b: str) -> int:
    return shared_prefix(a[::-1], b[::-1])


class Formatter:
    """Renders a conversation turn by turn.

    add() returns (new text, start of the turn's own text in it, its end, whether history was rewritten); when history was
    rewritten the new text is the whole output so far. local: whether the caller knows the template to be local.
    """

    def __init__(self, template: Template, full: int = FULL, lookback: int = LOOKBACK, local: bool = True):
        self.template, self.full, self.lookback = template, full, lookback
        self.turns: list[Turn] = []
        self.output = ""
        self.local, self.n = local, 0
        self.affixes: dict[tuple, tuple[int, int]] = {}

    def _delta(self, context: list[Turn], before: str, turn: Turn) -> tuple[str, bool]:
        after = self.template([*context, turn])
        return (after[len(before) :], False) if after.startswith(before) else (after, True)

    def _affix(self, context: list[Turn], role: str) -> tuple[int, int]:
        """Characters of the template before and after the text of a turn with this role."""
        key = (len(self.turns) < self.full and len(context), tuple(r for r, _ in context[-self.lookback :]), role)
        if not self.local or key not in self.affixes:
            near = context[-self.lookback :] if self.local else context
            x, y = (self.template([*near, (role, t)]) for t in "xy")
            begin = shared_prefix(x, y)
            before = self.template(near) if near else ""
            self.affixes[key] = (begin - (len(before) if x.startswith(before) else 0), shared_suffix(x, y))
        return self.affixes[key]

    def add(self, role: str, text: str) -> tuple[str, int, int, bool]:
        turn = (role, text)
        near = self.turns[-self.lookback :]
        if self.local and self.n >= self.full:
            delta, rewrote = self._delta(near, self.template(near), turn)
            if rewrote:
                raise ValueError("a template that is said to be local rewrote history")
        else:
            delta, rewrote = self._delta(self.turns, self.output, turn)
            if self.local and (rewrote or self._delta(near, self.template(near) if near else "", turn) != (delta, False)):
                self.local = self.n >= self.full and self.local
        lead, tail = self._affix(self.turns, role)
        self.turns.append(turn)
        self.n += 1
        if self.local and self.n >= self.full:
            self.turns, self.output = self.turns[-self.lookback :], ""
        else:
            self.output = delta if rewrote else self.output + delta
        return delta, lead, len(delta) - tail, rewrote


def _format(template: Template):
    """Sorted turns to segments of whole turns: conv_id, segment, text, n_turns, and loss spans in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        state: dict = {}
        local = getattr(template, "local", False)

        def close():
            if state and state["n"]:
                rows.append((state["id"], state["segment"], "".join(state["text"]), state["n"], state["loss"], state["rewrites"]))

        def flush():
            kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            types = [("conv_id", pa.int64()), ("segment", pa.int64()), ("text", pa.string()), ("n_turns", pa.int64()), ("loss", kind), ("rewrites", pa.int64())]
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(types)], names=[n for n, _ in types])
            rows.clear()
            return out

        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if not state or state["id"] != conv:
                    close()
                    state = {"id": conv, "segment": 0, "text": [], "n": 0, "at": 0, "loss": [], "rewrites": 0, "f": Formatter(template, local=local)}
                elif state["n"] >= SEGMENT_TURNS and state["f"].local:
                    close()
                    state |= {"segment": state["segment"] + 1, "text": [], "n": 0, "at": 0, "loss": []}
                delta, a, b, rewrote = state["f"].add(role or "", text or "")
                if rewrote:  # earlier spans no longer hold
                    state |= {"text": [], "at": 0, "loss": [], "rewrites": state["rewrites"] + 1}
                if role == "assistant":
                    state["loss"].append({"a": state["at"] + a, "b": state["at"] + b})
                state["text"].append(delta)
                state["at"] += len(delta)
                state["n"] += 1
            if len(rows) >= 200:
                yield flush()
        close()
        if rows:
            yield flush()

    return tidy(run)


def format_conversations(turns: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Segments of at most SEGMENT_TURNS whole turns, or of a whole conversation if the template isn't local: conv_id, segment, text, n_turns, loss (spans), rewrites.

    Segments of a conversation stand together and in order. The spans of a template that rewrites history
    (rewrites > 0) hold for the turns since the last rewriting.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").repartition("conv_id")
    rows = rows.sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")
    return rows.mapInArrow(_format(template), "conv_id long, segment long, text string, n_turns long, loss array<struct<a:long,b:long>>, rewrites long")


@tidy
def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation from its segments, which come together and in order."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    rows: list[tuple] = []
    state: dict = {}

    def close():
        if state:
            rows.append((state["id"], state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"]))

    def flush():
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)
        rows.clear()
        return out

    for batch in batches:
        for conv, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss"))):
            if not state or state["id"] != conv:
                close()
                state = {"id": conv, "n": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0}
            for role, said in parse(text):
                state["turns"].update(f"{role}\n{said}\n".encode())
                state["n"] += 1
            for span in loss:
                own = unescape(text[span["a"] : span["b"]])
                state["loss"].update(own.encode())
                state["loss_chars"] += len(own)
            state["chars"] += len(text)
        if len(rows) >= 1000:
            yield flush()
    close()
    if rows:
        yield flush()


def read_back(segments: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read from formatted segments."""
    return segments.select("conv_id", "text", "loss").mapInArrow(
        _read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


PROBE = "</s>[INST] ok [/INST]"


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(f"SELECT -7L AS conv_id, turn, role, '{PROBE}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return read_back(format_conversations(turns.unionByName(probe)))




def _escaped_sql(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


ORACLE_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'),
e AS (
  SELECT *, length({_escaped_sql("text")}) + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 6 WHEN 'system' THEN 18
    ELSE 20 + length({_escaped_sql("role")}) END AS chars,
    CASE WHEN role = 'assistant' THEN text ELSE '' END AS own
  FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(length(own)) AS BIGINT) AS loss_chars, sha256(string_agg(own, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
