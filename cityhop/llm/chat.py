"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, and only that reply
trainable (``loss_start``/``loss_end``, in code points of the example's text).  A conversation that does not
end with an assistant turn also gives one example without a trainable span, so that no turn is lost.

A turn is written ``### role: text</turn>`` and a line feed.  Inside roles and texts a backslash is doubled
and ``###`` and ``</turn>`` get a backslash before them (in a role also ``:``), which is undone by dropping the
backslash; an unescaped closing mark can therefore only be the template's.

Rows of a conversation are ordered by turn (nulls first), then role, then text; equal rows stay as turns of
their own.  Null roles and texts are empty; a null id is a conversation like any other; extra columns are
ignored; an empty table gives no examples.  A task holds one conversation's formatted turns at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "### ", "</turn>"
TRAINABLE = "assistant"
_CONTROL = re.compile(r"\\|###|</turn>")
_CONTROL_ROLE = re.compile(r"\\|###|</turn>|:")
_UNESCAPE = re.compile(r"\\(\\|###|</turn>|:)")
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)


def escape(text: str, control: re.Pattern = _CONTROL) -> str:
    return control.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def head(role: str) -> str:
    return f"{OPEN}{escape(role, _CONTROL_ROLE)}: "


def read_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at code point {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def _expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["conv", "example", "text", "loss_start", "loss_end"]
    out, size = [], 0
    started, conv, prefix, example, pending = False, None, "", 0, False

    def close() -> None:
        if pending:
            out.append((conv, example, prefix, None, None))

    def table() -> pd.DataFrame:
        pdf = pd.DataFrame(out, columns=columns)
        return pdf.astype({"loss_start": "Int64", "loss_end": "Int64"})

    for pdf in batches:
        for key, role, text in zip(pdf["conv"], pdf["role"], pdf["text"]):
            if not started or key != conv:
                close()
                started, conv, prefix, example, pending = True, key, "", 0, False
            role = role or ""
            lead, body = head(role), escape(text or "")
            begin = len(prefix) + len(lead)
            prefix = f"{prefix}{lead}{body}{CLOSE}\n"
            pending = role != TRAINABLE
            if not pending:
                out.append((conv, example, prefix, begin, begin + len(body)))
                size += len(prefix)
                example += 1
            if size > 1 << 22:
                yield table()
                out, size = [], 0
    close()
    if out:
        yield table()


def expand(
    conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per example: id, example (from 0, in turn order), text, loss_start, loss_end."""
    kind = conversations.schema[id_col].dataType
    rows = conversations.select(
        F.col(id_col).cast("string").alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")
    )
    rows = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")
    out = rows.mapInPandas(_expand, "conv string, example long, text string, loss_start long, loss_end long")
    return out.withColumn("conv", F.col("conv").cast(kind)).withColumnRenamed("conv", id_col)


def _read_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    out: list[tuple] = []
    started, conv, last, chars, loss_chars, loss = False, None, "", 0, 0, hashlib.sha256()

    def close() -> None:
        if started:
            turns = read_turns(last)
            said = hashlib.sha256()
            for role, text in turns:
                said.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            out.append((conv, len(turns), said.hexdigest(), loss_chars, loss.hexdigest(), chars))

    for pdf in batches:
        for key, text, a, b in zip(pdf["conv"], pdf["text"], pdf["loss_start"], pdf["loss_end"]):
            if not started or key != conv:
                close()
                started, conv, chars, loss_chars, loss = True, key, 0, 0, hashlib.sha256()
            last = text
            chars += len(text)
            if a == a and a is not None:
                reply = unescape(text[int(a) : int(b)])
                loss_chars += len(reply)
                loss.update(reply.encode("utf-8", "surrogatepass"))
        if len(out) > 10_000:
            yield pd.DataFrame(out, columns=columns)
            out = []
    close()
    if out:
        yield pd.DataFrame(out, columns=columns)


def read_back(examples: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Digests of each conversation from its examples alone.

    The examples of a conversation must follow one another in a partition, in order, as ``expand`` leaves them.
    """
    kind = examples.schema[id_col].dataType
    rows = examples.select(F.col(id_col).cast("string").alias("conv"), "text", "loss_start", "loss_end")
    out = rows.mapInPandas(_read_back, "conv string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.withColumn("conv", F.col("conv").cast(kind)).withColumnRenamed("conv", id_col)
