"""Chat formatting: typed content parts, a reversible template and a loss mask.

A turn holds a plain text or a list of typed parts.  ``PartVisitor`` walks the
parts and flattens them into one text with an ordered placeholder per
attachment (``<|image|>`` and the like), recording its reference and the
number of tokens that it expands to.  A turn is then written as

    <|turn|>role<|text|>text<|end|>

Control strings inside roles and texts are broken by a backslash put behind
every ``<`` and ``[``; taking these backslashes out again restores the text,
whatever it holds.  The loss mask is a list of [start, end) code points of the
formatted text, one per assistant turn.

Scale: turns are formatted where they are read, then joined in two steps, by
(conversation, block of turns) and by conversation, so a conversation of many
turns arrives in few rows; only its own text is ever held at once.

Cases: a null role, text or part counts as empty; a conversation's rows are
ordered by (turn, role, text), null turns first, repeated rows stay; other
columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
LOSS_ROLE = "assistant"
BLOCK = 64                                     # turns joined in the first step
PARTS = "array<struct<kind:string,text:string,ref:string,units:bigint>>"
ATTACHMENTS = "array<struct<position:int,kind:string,ref:string,tokens:bigint>>"
# Tokens per unit: an image patch, a second of audio, a document page.
TOKENS_PER_UNIT = {"image": 1, "audio": 25, "document": 512}


def escape(s: str) -> str:
    return s.replace("<", "<\\").replace("[", "[\\")


def unescape(s: str) -> str:
    return s.replace("<\\", "<").replace("[\\", "[")


class PartVisitor:
    """Flattens the parts of a turn; ``pieces`` are already escaped."""

    def __init__(self, tokens_per_unit: dict[str, int]):
        self.tokens_per_unit = tokens_per_unit
        self.pieces: list[str] = []
        self.attachments: list[tuple] = []

    def visit(self, part) -> None:
        getattr(self, f"visit_{part['kind'] or 'text'}", self.visit_unknown)(part)

    def visit_text(self, part) -> None:
        self.pieces.append(escape(part["text"] or ""))

    def visit_image(self, part) -> None:
        self._attach(part, "image")

    def visit_audio(self, part) -> None:
        self._attach(part, "audio")

    def visit_document(self, part) -> None:
        self._attach(part, "document")
        self.visit_text(part)                          # a document's own text follows its placeholder

    def visit_unknown(self, part) -> None:
        raise ValueError(f"unknown part kind {part['kind']!r}")

    def _attach(self, part, kind: str) -> None:
        tokens = int(part["units"] or 1) * self.tokens_per_unit[kind]
        self.attachments.append((len(self.attachments), kind, part["ref"], tokens))
        self.pieces.append(f"<|{kind}|>")


def format_turns(turns: DataFrame, tokens_per_unit: dict[str, int] | None = None) -> DataFrame:
    """conv_id, turn, role, chunk, loss (code points [start, end) of the chunk, or null), attachments.

    ``turns`` has conv_id, turn, role and text, and optionally ``parts`` (``PARTS``), which then
    replaces the text where it is not null."""
    units = tokens_per_unit or TOKENS_PER_UNIT
    parts = F.col("parts").cast(PARTS) if "parts" in turns.columns else F.lit(None).cast(PARTS)
    df = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                      F.coalesce("text", F.lit("")).alias("text"), parts.alias("parts"))

    @F.pandas_udf(f"chunk string, loss_start bigint, loss_end bigint, attachments {ATTACHMENTS}")
    def write(role: pd.Series, text: pd.Series, parts: pd.Series) -> pd.DataFrame:
        out = []
        for r, t, p in zip(role, text, parts, strict=True):
            v = PartVisitor(units)
            for part in [{"kind": "text", "text": t}] if p is None else p:
                v.visit(part)
            head, body = TURN + escape(r) + TEXT, "".join(v.pieces)
            mask = (len(head), len(head) + len(body)) if r == LOSS_ROLE else (None, None)
            out.append((head + body + END, *mask, v.attachments))
        frame = pd.DataFrame(out, columns=["chunk", "loss_start", "loss_end", "attachments"])
        return frame.astype({"loss_start": "Int64", "loss_end": "Int64"})

    return df.select("conv_id", "turn", "role", "text", write("role", "text", "parts").alias("w")) \
        .select("conv_id", "turn", "role", "text", "w.*")


def format_conversations(turns: DataFrame, tokens_per_unit: dict[str, int] | None = None) -> DataFrame:
    """conv_id, n_turns, formatted, loss_spans, attachments (position in the conversation), expanded_tokens."""
    t = format_turns(turns, tokens_per_unit).withColumn("block", F.floor(F.col("turn") / BLOCK))
    part = F.struct("turn", "role", "text", "chunk", "loss_start", "loss_end", "attachments")
    joined = F.struct(
        F.col("block"), F.array_join(F.col("p.chunk"), "").alias("chunk"), F.size("p").alias("n"),
        F.transform("p", lambda x: F.struct(F.length(x["chunk"]).alias("len"), x["loss_start"].alias("s"),
                                            x["loss_end"].alias("e"))).alias("marks"),
        F.flatten(F.col("p.attachments")).alias("attachments"))
    b = t.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(part)).alias("p")).select("conv_id", joined.alias("b"))
    c = b.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(
        F.coalesce(F.col("b.block"), F.lit(-(2 ** 62))).alias("block"), "b.chunk", "b.n", "b.marks", "b.attachments"))).alias("b"))

    @F.pandas_udf("array<struct<start:bigint,end:bigint>>")
    def spans(marks: pd.Series) -> pd.Series:
        out = []
        for conv in marks:
            at, found = 0, []
            for m in conv:
                if m["s"] is not None:
                    found.append({"start": at + m["s"], "end": at + m["e"]})
                at += m["len"]
            out.append(found)
        return pd.Series(out)

    atts = F.transform(F.flatten(F.col("b.attachments")), lambda x, i: F.struct(
        i.cast("int").alias("position"), x["kind"].alias("kind"), x["ref"].alias("ref"), x["tokens"].alias("tokens")))
    return c.select("conv_id", F.aggregate("b", F.lit(0).cast("bigint"), lambda a, x: a + x["n"]).alias("n_turns"),
                    F.array_join(F.col("b.chunk"), "").alias("formatted"), spans(F.flatten(F.col("b.marks"))).alias("loss_spans"),
                    atts.alias("attachments")) \
        .withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda a, x: a + x["tokens"]))


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation; placeholders stay in the text."""
    out = []
    for chunk in formatted.split(TURN)[1:]:
        role, text = chunk.removesuffix(END).split(TEXT, 1)
        out.append((unescape(role), unescape(text)))
    return out


def read_back(conversations: DataFrame) -> DataFrame:
    """Digests of formatted conversations, read from ``formatted`` and ``loss_spans`` alone."""
    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            out = []
            for conv_id, formatted, spans in zip(d["conv_id"], d["formatted"], d["loss_spans"], strict=True):
                turns, all_turns = parse(formatted), hashlib.sha256()
                for role, text in turns:
                    all_turns.update(f"{role}\n{text}\n".encode())
                loss = "".join(unescape(formatted[s["start"]:s["end"]]) for s in spans)
                out.append((conv_id, len(turns), all_turns.hexdigest(), len(loss),
                            hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
            yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
                                             "formatted_chars"]).astype({"conv_id": d["conv_id"].dtype})
    kind = conversations.schema["conv_id"].dataType.simpleString()
    return conversations.select("conv_id", "formatted", "loss_spans").mapInPandas(
        digests, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
                 "formatted_chars bigint")
