"""Chat formatting: a finite-state machine over roles, and segments with loss flags from a template."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldlog.llm.common import small_batches

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """What stands around each turn, which roles may follow which, and which roles' texts carry loss."""

    header: str = "### {label}: "
    end: str = "</turn>"
    between: str = "\n"
    labels: dict = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss_roles: tuple = ("assistant",)
    follows: dict = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    may_end: tuple = ("assistant", "user")

    @property
    def controls(self) -> tuple[str, str]:
        """The strings that mean something in the output: the header's mark and the end mark."""
        return self.header.split("{label}")[0], self.end


def escape(text: str, controls: tuple[str, ...]) -> str:
    """Doubles each escape character, then puts one before each control string."""
    text = text.replace(ESCAPE, ESCAPE * 2)
    return re.sub("|".join(map(re.escape, controls)), lambda m: ESCAPE + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def read_turns(template: Template, text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, from formatted text alone."""
    mark, tail = template.controls[0], template.header.split("{label}")[1]
    roles = {v: k for k, v in template.labels.items()}
    out, at = [], 0
    body = rf"((?:[^\\]|\\.)*?)"
    turn = re.compile(re.escape(mark) + body + re.escape(tail) + body + re.escape(template.end) + re.escape(template.between), re.S)
    while at < len(text):
        m = turn.match(text, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        label = m[1]
        out.append((unescape(label[1:]) if label.startswith("?") else roles[label], unescape(m[2])))
        at = m.end()
    return out


def segments(template: Template, role: str, text: str) -> list[tuple[str, bool]]:
    """The segments of one turn: its header, its escaped text, its end."""
    known = template.labels.get(role)
    tail = template.header.split("{label}")[1]
    label = known if known is not None else "?" + escape(role, (*template.controls, tail))
    return [(template.header.format(label="{label}").replace("{label}", label), False), (escape(text, template.controls), role in template.loss_roles), (template.end + template.between, False)]


def chat_segments(df: DataFrame, template: Template | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn: conv_id, turn, segments ARRAY<STRUCT<text, loss>>, state, valid, last.

    The machine starts in "start"; `valid` is false from the first turn whose role may not follow the state
    before it, and on a last turn whose role may not end a conversation. Invalid conversations are kept and
    marked. The rows of a conversation come in order within one partition and pass through as a stream, so a
    conversation of any length needs the memory of one batch. Nulls: a null text or role counts as empty
    text, rows with a null conv_id form one conversation, null turns come first. Ties of turn are ordered by
    role, then text; repeated rows are turns of their own. Extra columns are not carried. Empty in, empty out.
    """
    template = template or Template()
    small_batches(df.sparkSession)
    rows = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = dict(ordered.dtypes)
    # pandas has no null integers: ids travel as text
    ordered = ordered.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("string").alias("turn"), "role", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, state, valid, held = None, None, True, None
        for rows in batches:
            out = []
            for c, t, role, text in zip(rows["conv_id"], rows["turn"], rows["role"], rows["text"]):
                if state is None or c != conv:
                    if held is not None:
                        out.append(close(held))
                    conv, state, valid = c, "start", True
                elif held is not None:
                    out.append(held)
                valid = valid and role in template.follows.get(state, ())
                state = role
                held = (c, t, [{"text": x, "loss": y} for x, y in segments(template, role, text)], role, valid, False)
            yield frame(out)
        if held is not None:
            yield frame([close(held)])

    def close(row: tuple) -> tuple:
        return (*row[:4], row[4] and row[3] in template.may_end, True)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["conv_id", "turn", "segments", "state", "valid", "last"])

    made = ordered.mapInPandas(run, "conv_id string, turn string, segments array<struct<text: string, loss: boolean>>, state string, valid boolean, last boolean")
    return made.select(F.col("conv_id").cast(kind["conv_id"]).alias("conv_id"), F.col("turn").cast(kind["turn"]).alias("turn"), "segments", "state", "valid", "last")


def chat_digests(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """Per conversation of chat_segments(): counts and digests, read back from the formatted segments.

    turns_sha256 is over role, newline, text, newline of each turn as parsed from the output; loss_sha256 over
    the unescaped text under the loss mask. Takes the rows in the order and partitions chat_segments() left
    them in, and keeps two running digests, never a whole conversation.
    """
    template = template or Template()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = None
        for rows in batches:
            out = []
            for c, segs, valid, last in zip(rows["conv_id"], rows["segments"], rows["valid"], rows["last"]):
                at = at or [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = "".join(s["text"] for s in segs)
                for role, said in read_turns(template, text):
                    at[0] += 1
                    at[1].update(f"{role}\n{said}\n".encode())
                loss = unescape("".join(s["text"] for s in segs if s["loss"]))
                at[2] += len(loss)
                at[3].update(loss.encode())
                at[4] += len(text)
                if last:
                    out.append((c, at[0], at[1].hexdigest(), at[2], at[3].hexdigest(), at[4], bool(valid)))
                    at = None
            yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"])

    kind = dict(turns.dtypes)["conv_id"]
    named = turns.withColumn("conv_id", F.col("conv_id").cast("string"))
    made = named.mapInPandas(run, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
    return made.withColumn("conv_id", F.col("conv_id").cast(kind))
