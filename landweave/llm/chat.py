"""Chat formatting from a declarative template, with a role state machine and loss flags.

Conversations are dealt by id and sorted by turn, and each task streams its rows: one state is kept for
the conversation at hand, and nothing is gathered. The machine's transitions say which role may follow
which; a turn out of order is flagged, as are the rest of its conversation, but still formatted.

A turn becomes segments (text, loss flag): the role's opening mark, the escaped text, its closing mark.
Only texts of roles with ``loss`` are under the loss mask. Escaping is reversible: a backslash is
doubled, and a control string inside a text gets ``\\-`` after its first character, so that no control
string is left in any text.

Cases: null texts and roles are empty; unknown roles have a general mark that carries their name; turns
that tie are ordered by role and text; repeated rows are turns of their own; rows with a null id are one
conversation; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landweave.storage import partitions


@dataclass(frozen=True)
class Template:
    """Marks and flag of each role; the mark of any other role; allowed transitions from each state."""

    roles: dict = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>", False), "user": ("[INST]", "[/INST]", False), "assistant": ("[ASST]", "</s>", True)})
    other: tuple = ("[ROLE]", "[TEXT]", "[/ROLE]")
    extra: tuple = ("<s>", "[/ASST]")
    order: dict = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple = ("assistant",)

    def controls(self) -> list[str]:
        return sorted({m for r in self.roles.values() for m in r[:2]} | {*self.other, *self.extra}, key=lambda m: (-len(m), m))


class Writer:
    def __init__(self, template: Template):
        self.template = template
        self.pattern = re.compile("|".join(map(re.escape, ["\\", *template.controls()])))

    def escape(self, text: str) -> str:
        return self.pattern.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\-" + m[0][1:], text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        t = self.template
        if role in t.roles:
            opening, closing, loss = t.roles[role]
        else:
            opening, closing, loss = t.other[0] + self.escape(role) + t.other[1], t.other[2], False
        return [(opening, False), (self.escape(text), loss), (closing, False)]

    def after(self, state: str, role: str) -> str:
        return role if role in self.template.order.get(state, ()) else "invalid"


class Reader:
    """Turns back from formatted text."""

    def __init__(self, template: Template):
        t = self.template = template
        self.marks = {opening: role for role, (opening, _, _) in t.roles.items()}
        self.pattern = re.compile("|".join(map(re.escape, t.controls())))

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\|-)", lambda m: "\\" if m[1] == "\\" else "", text)

    def turns(self, text: str):
        t, at, role = self.template, 0, None
        for m in self.pattern.finditer(text):
            inner = text[at : m.start()]
            at = m.end()
            if m[0] in self.marks:
                role = self.marks[m[0]]
            elif m[0] == t.other[1]:
                role = self.unescape(inner)
            elif m[0] != t.other[0]:
                yield role, self.unescape(inner)


TURN = "n long, turn long, role string, state string, segments array<struct<text:string,loss:boolean>>"


def format_turns(conversations: DataFrame, template: Template | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id``, ``n`` (from 0), ``turn``, ``role``, machine ``state`` after the turn, ``segments``; in order within each partition."""
    template = template or Template()
    kind = conversations.schema[id_col].dataType.simpleString()

    def run(batches):
        writer, now, state, n = Writer(template), object(), "start", 0
        for b in batches:
            out = [[] for _ in range(5)]
            for conv, turn, role, text in zip(*(c.to_pylist() for c in b.columns)):
                if conv != now:
                    now, state, n = conv, "start", 0
                state = writer.after(state, role)
                parts = [{"text": s, "loss": f} for s, f in writer.segments(role, text)]
                for col, v in zip(out, (n, turn, role, state, parts)):
                    col.append(v)
                n += 1
            seg = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
            cols = [b.column(0), *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string(), seg)))]
            yield pa.record_batch(cols, names=["conv_id", "n", "turn", "role", "state", "segments"])

    rows = conversations.select(F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = rows.repartition(partitions(conversations.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, f"conv_id {kind}, {TURN}")


def read_back(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation, from the formatted text alone; ``turns`` as :func:`format_turns` orders them."""
    template = template or Template()

    def run(batches):
        reader, now, one = Reader(template), object(), None

        def start(conv):
            return {"conv_id": conv, "n_turns": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "formatted_chars": 0, "state": "start"}

        def row(x, kind):
            cols = [pa.array([x["conv_id"]], kind), *(pa.array([v]) for v in (x["n_turns"], x["turns"].hexdigest(), x["loss_chars"], x["loss"].hexdigest(), x["formatted_chars"], x["state"] in template.final))]
            return pa.record_batch(cols, names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"])

        kind = None
        for b in batches:
            kind = b.column(0).type
            for conv, state, segments in zip(*(c.to_pylist() for c in b.columns)):
                if conv != now or one is None:
                    if one is not None:
                        yield row(one, kind)
                    now, one = conv, start(conv)
                text = "".join(s["text"] for s in segments)
                for role, said in reader.turns(text):
                    one["n_turns"] += 1
                    one["turns"].update(f"{role}\n{said}\n".encode())
                for s in segments:
                    if s["loss"]:
                        said = reader.unescape(s["text"])
                        one["loss_chars"] += len(said)
                        one["loss"].update(said.encode())
                one["formatted_chars"] += len(text)
                one["state"] = state
        if one is not None:
            yield row(one, kind)

    kind = turns.schema["conv_id"].dataType.simpleString()
    return turns.select("conv_id", "state", "segments").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


#: The conversation that the contract adds.
PROBE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def digest(conversations: DataFrame) -> DataFrame:
    probe = conversations.sparkSession.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return read_back(format_turns(conversations.select("conv_id", "turn", "role", "text").unionByName(probe)))


#: The digest in SQL, for the template's own marks.
ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
m AS (SELECT *, lag(role, 1, 'start') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
  regexp_extract_all(text, '\\|<</SYS>>|<<SYS>>|\[/ASST\]|\[/INST\]|\[/ROLE\]|\[ASST\]|\[INST\]|\[ROLE\]|\[TEXT\]|</s>|<s>') AS marks FROM t),
e AS (SELECT *, length(text) + len(marks) + len(list_filter(marks, lambda x: x <> '\'))
  + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 10 ELSE 19 + length(role) END AS n,
  before || '>' || role IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user') AS ok FROM m)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars, bool_and(ok) AND last(role ORDER BY turn NULLS FIRST, role, text) = 'assistant' AS valid
FROM e GROUP BY conv_id
"""
