r"""Chat formatting as a relational job, in Spark expressions only.

Turns of a conversation are collected as structs and sorted; adjacent turns of one
role are merged under one header by an array aggregation; the pieces are concatenated
to the formatted text. A `Template` has four control strings:

    {header}role{body}{begin}text{end}{begin}text{end}{header}role{body}...

Inside roles and texts a control string gets a backslash after its first character,
and a backslash becomes two, so control strings stand where the template put them and
nowhere else, and `unescape` gives back the original. The loss mask is kept beside the
text: `pieces` are (text, loss) in order, their concatenation is the text, and those with
`loss` are the (escaped) texts of the trained roles.

`turns_of` and `loss_text` read turns and masked text back from what was written.

Defined cases: turns go by turn number (null first), equal ones by role and text, and
repeated rows count each; null text is empty; a null role is the role "", and is read
back as such; a null conversation is one of its own; an empty table gives an empty
result; other columns are not read.

Plan: one exchange, by conversation. A conversation is one row of the result, so its
turns meet in one task however they are dealt; beyond that nothing is collected, and all
work in a row is in proportion to its length: the aggregation runs over blocks of turns,
each of which begins with the role before it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64  # turns that one aggregation appends to its array


@dataclass(frozen=True)
class Template:
    header: str = "[INST]"
    body: str = "[/INST]"
    begin: str = "<s>"
    end: str = "</s>"

    def __post_init__(self):
        marks = self.marks
        firsts = {m[:1] for m in marks}
        if not all(len(m) > 1 for m in marks) or any(c in m[1:] for m in marks for c in firsts) or any("\\" in m for m in marks) or len(set(marks)) < len(marks):
            raise ValueError("control strings must differ, have two characters at least and no backslash, and begin with characters that they don't have elsewhere")

    @property
    def marks(self) -> tuple[str, ...]:
        return self.header, self.body, self.begin, self.end

    def escape(self, text: Column) -> Column:
        inside = "|".join(f"{_quoted(m[0])}(?={_quoted(m[1:])})" for m in self.marks)
        return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), inside, r"$0\\")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _quoted(text: str) -> str:
    """The text as a regular expression."""
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", text)


def _pieces(turns: Column, template: Template, trained: tuple[str, ...]) -> Column:
    """(text, loss) of sorted turns (role, text)."""
    t, lit = template, lambda s: F.lit(s).cast("string")
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))

    def merged(done: Column, turn: Column) -> Column:
        """A turn of the role before it goes on under its header."""
        new = F.concat(lit(t.header), t.escape(turn["role"]), lit(t.body), lit(t.begin))
        head = F.when(turn["role"] == done["role"], lit(t.begin)).otherwise(new)
        own = F.array(piece(head, F.lit(False)), piece(t.escape(turn["text"]), turn["role"].isin(*trained)), piece(lit(t.end), F.lit(False)))
        return F.struct(turn["role"].alias("role"), F.concat(done["pieces"], own).alias("pieces"))

    def block(i: Column) -> Column:
        before = F.get(turns, i * BLOCK - 1)["role"]  # null before the first turn: a header is written
        none = F.array().cast("array<struct<text:string,loss:boolean>>")
        start = F.struct(before.cast("string").alias("role"), none.alias("pieces"))
        return F.aggregate(F.slice(turns, i * BLOCK + 1, F.lit(BLOCK)), start, merged, lambda done: done["pieces"])

    blocks = F.sequence(F.lit(0), F.floor((F.size(turns) - 1) / BLOCK).cast("int"))
    return F.flatten(F.transform(blocks, block))


def format_chats(turns: DataFrame, template: Template | None = None, trained: tuple[str, ...] = ("assistant",), key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, formatted and pieces (text, loss) of each conversation."""
    template = template or Template()
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text"))]
    rows = turns.select(F.col(key).cast("long").alias("conv_id"), F.struct(F.col(order).cast("long").alias("turn"), *said).alias("said"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("turns"))
    pieces = chats.select("conv_id", _pieces(F.col("turns"), template, trained).alias("pieces"))
    return pieces.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"), "pieces")


def turns_of(formatted: Column, template: Template | None = None) -> Column:
    """Array of (role, text) read back from a formatted text."""
    t = template or Template()

    def run(block: Column) -> Column:
        """One header and the texts under it."""
        cut = F.split(block, _quoted(t.body))
        role = t.unescape(F.get(cut, F.lit(0)))
        texts = F.split(F.get(cut, F.lit(1)), _quoted(t.end))
        own = F.slice(texts, F.lit(1), F.size(texts) - 1)  # nothing stands behind the last end
        opened = len(t.begin) + 1
        return F.transform(own, lambda x: F.struct(role.alias("role"), t.unescape(F.substring(x, opened, 2**31 - 1)).alias("text")))

    blocks = F.split(formatted, _quoted(t.header))
    return F.flatten(F.transform(F.slice(blocks, F.lit(2), F.size(blocks)), run))


def loss_text(pieces: Column, template: Template | None = None) -> Column:
    """All text under the mask, as it was before it was escaped."""
    t = template or Template()
    masked = F.filter(pieces, lambda p: p["loss"])
    return F.array_join(F.transform(masked, lambda p: t.unescape(p["text"])), "")


def digests(chats: DataFrame, template: Template | None = None) -> DataFrame:
    """What is read back from formatted chats, in figures and digests."""
    read = chats.select("conv_id", turns_of(F.col("formatted"), template).alias("turns"), loss_text(F.col("pieces"), template).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), sha(lines).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), sha(F.col("loss")).alias("loss_sha256"), "formatted_chars")
