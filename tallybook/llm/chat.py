"""Chat formatting: a finite-state machine over roles, and segments with loss flags from a declarative template."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

START, END = "start", "end"


@dataclass(frozen=True)
class Template:
    """How turns are written.

    ``marks``: opening and closing string of each known role; turns of other roles are written as ``other[0]``, the role,
    ``role_end``, the text and ``other[1]``. ``loss``: roles whose texts are learned. ``moves``: states that may follow a
    state, a state being the role of the last turn. No mark may be a part of another or end as another begins.
    """

    marks: Mapping[str, tuple[str, str]] = field(default_factory=lambda: {
        "system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"),
    })
    other: tuple[str, str] = ("[TURN]", "[/TURN]")
    role_end: str = "[ROLE]"
    loss: frozenset[str] = frozenset({"assistant"})
    moves: Mapping[str, frozenset[str]] = field(default_factory=lambda: {
        START: frozenset({"system", "user"}), "system": frozenset({"user"}), "user": frozenset({"assistant"}),
        "assistant": frozenset({"user", END}),
    })

    @property
    def control(self) -> list[str]:
        """Every string that text must not hold unescaped."""
        return [m for pair in self.marks.values() for m in pair] + [*self.other, self.role_end]


def escape(text: Column, template: Template) -> Column:
    """Double every backslash and put one after the first character of every control string."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in template.control:
        text = F.replace(text, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def _ordered(conversations: DataFrame) -> DataFrame:
    """Rows with filled gaps and ``at``, the number of a turn in its conversation; equal turns go by role and text."""
    filled = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return filled.withColumn("at", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")))


def segments(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, at, part, text, loss, role, state, legal): what is written, in the order of (at, part).

    A turn makes three segments: its opening (part 0), its escaped text (1, learned if its role is) and its closing (2).
    ``state`` is the state of the machine before the turn, ``legal`` whether the template allows the turn there. Null
    roles and texts count as empty; rows with a null conv_id form one conversation. Turns are dealt by conversation, so a
    conversation is sorted (with spilling) in one task, as its text is one training example.
    """
    rows = _ordered(conversations)
    order = Window.partitionBy("conv_id").orderBy("at")
    rows = rows.withColumn("state", F.coalesce(F.lag("role").over(order), F.lit(START)))
    allowed = F.lit(False)
    for state, after in template.moves.items():
        allowed = allowed | ((F.col("state") == state) & F.col("role").isin(*sorted(after)))
    opening = F.concat(F.lit(template.other[0]), escape(F.col("role"), template), F.lit(template.role_end))
    closing = F.lit(template.other[1])
    for role, (first, last) in template.marks.items():
        opening = F.when(F.col("role") == role, F.lit(first)).otherwise(opening)
        closing = F.when(F.col("role") == role, F.lit(last)).otherwise(closing)
    learned = F.col("role").isin(*sorted(template.loss))
    parts = F.array(
        F.struct(F.lit(0).alias("part"), opening.alias("text"), F.lit(False).alias("loss")),
        F.struct(F.lit(1).alias("part"), escape(F.col("text"), template).alias("text"), learned.alias("loss")),
        F.struct(F.lit(2).alias("part"), closing.alias("text"), F.lit(False).alias("loss")),
    )
    made = rows.select("conv_id", "at", "role", "state", allowed.alias("legal"), F.explode(parts).alias("s"))
    return made.select("conv_id", "at", "s.part", "s.text", "s.loss", "role", "state", "legal")


class Reader:
    """Reads formatted text back piece by piece: no more than the open turn is held.

    What is learned is the text of the pieces whose flag is set. Roles and texts are parsed from the marks alone, and
    ``mask_matches`` tells whether the flagged text is that of the roles the template learns.
    """

    def __init__(self, template: Template):
        self.template = template
        self.cut = re.compile("|".join(re.escape(m) for m in sorted(template.control, key=len, reverse=True)))
        self.longest = max(map(len, template.control))
        self.opening = {first: role for role, (first, _) in template.marks.items()} | {template.other[0]: None}
        self.begin()

    def begin(self) -> None:
        self.rest, self.role, self.open, self.turns, self.legal = "", START, False, 0, True
        self.all, self.learned, self.of_roles = hashlib.sha256(), hashlib.sha256(), hashlib.sha256()
        self.loss_chars, self.chars, self.body = 0, 0, []

    def take(self, piece: str, loss: bool, legal: bool) -> None:
        """A segment: its text, whether it is learned, and whether its turn was allowed."""
        self.legal = self.legal and legal
        if loss:  # a segment holds a whole escaped text
            text = unescape(piece)
            self.learned.update(text.encode())
            self.loss_chars += len(text)
        self.feed(piece)

    def feed(self, piece: str) -> None:
        self.chars += len(piece)
        self.rest += piece
        at = 0
        for mark in self.cut.finditer(self.rest):
            self.body.append(self.rest[at : mark.start()])
            self.meet(mark.group())
            at = mark.end()
        keep = max(at, len(self.rest) - self.longest + 1)  # a mark may go on in the next piece
        self.body.append(self.rest[at:keep])
        self.rest = self.rest[keep:]

    def meet(self, mark: str) -> None:
        text, self.body = "".join(self.body), []
        if mark in self.opening:
            self.role, self.open = self.opening[mark], True
        elif mark == self.template.role_end:
            self.role = unescape(text)
        elif self.open:
            text = unescape(text)
            self.all.update(f"{self.role}\n{text}\n".encode())
            self.turns += 1
            if self.role in self.template.loss:
                self.of_roles.update(text.encode())
            self.open = False

    def row(self) -> tuple:
        legal = self.legal and END in self.template.moves.get(self.role, ())
        matches = self.learned.digest() == self.of_roles.digest()
        return self.turns, self.all.hexdigest(), self.loss_chars, self.learned.hexdigest(), self.chars, legal, matches


COLUMNS = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "legal", "mask_matches")


def read_back(written: DataFrame, template: Template = Template()) -> DataFrame:
    """One row a conversation, read from its segments: number of turns and digest of roles and texts, parsed from the marks;
    length and digest of the text under the loss flags; formatted length; ``legal``: the machine allowed every turn, and a
    conversation may end after the last; ``mask_matches``: the flags cover just the texts of the learned roles.

    Segments of a conversation pass in order through one task, which holds the open turn only. Rows with a null conv_id are
    one conversation; an empty table gives an empty result.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, now, known = Reader(template), None, False
        out = []
        for batch in batches:
            for conv, missing, text, loss, legal in zip(batch["conv_id"], batch["missing"], batch["text"], batch["loss"], batch["legal"]):
                name = None if missing else conv
                if not known or name != now:
                    if known:
                        out.append((now, *reader.row()))
                        reader.begin()
                    now, known = name, True
                reader.take(text, loss, legal)
            if out:
                yield frame(out)
                out = []
        if known:
            yield frame([(now, *reader.row())])

    def frame(rows: list[tuple]) -> pd.DataFrame:
        made = pd.DataFrame(rows, columns=list(COLUMNS))
        return made.astype({"conv_id": "Int64"}) if numeric else made

    kind = dict(written.dtypes)["conv_id"]
    numeric = kind in ("bigint", "int", "smallint", "tinyint")
    sorted_ = written.repartition("conv_id").sortWithinPartitions("conv_id", "at", "part")
    chosen = sorted_.select(F.coalesce("conv_id", F.lit(0)).alias("conv_id") if numeric else "conv_id", F.col("conv_id").isNull().alias("missing"), "text", "loss", F.coalesce("legal", F.lit(False)).alias("legal"))
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, legal boolean, mask_matches boolean"
    return chosen.mapInPandas(parse, schema)
