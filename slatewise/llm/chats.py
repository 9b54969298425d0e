"""Chat formatting: a declarative template, a finite-state machine over roles, segments with loss flags, and the way back.

The template names a role's opening and closing marks, the roles that are trained on, and which role may follow in which
state. A turn becomes segments (text, loss): mark, text, mark, where only the text of trained roles bears loss. Texts that hold a mark, the
beginning of one at their end, or the escape sign itself get the escape sign before it, so that every mark left is the
template's own and the texts can be read back exactly.

A conversation is cut into pieces of bounded size. Each piece gives a map from every state before it to the state after
it; the maps of a conversation are composed in order, which gives each piece the state it starts in, and the turns of all pieces are then checked and
formatted on their own.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.llm import turns

BROKEN = "broken"


@dataclass(frozen=True)
class Template:
    """Marks by role, marks of any other role (before its name, after it, after its text), trained roles and turn order.

    `order` maps state and role to the next state, from state `start`; any other turn leads to `broken`, for good. `final`
    are the states in which a conversation may end.
    """

    marks: dict[str, tuple[str, str]]
    other: tuple[str, str, str]
    trained: frozenset[str]
    order: dict[str, dict[str, str]]
    final: frozenset[str]
    escape: str
    controls: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        opening = [m[0] for m in self.marks.values()] + [self.other[0]]
        controls = tuple(dict.fromkeys([*opening, *(m[1] for m in self.marks.values()), *self.other[1:]]))
        if len(set(opening)) < len(opening) or any(not c or self.escape in c for c in controls) or len(self.escape) != 1:
            raise ValueError("Opening marks must differ, no mark may be empty or hold the escape sign")
        if any(a != b and b.startswith(a) for a in controls for b in controls):
            raise ValueError("No mark may begin another one")
        object.__setattr__(self, "controls", controls)
        heads = dict.fromkeys(c[:n] for c in controls for n in range(1, len(c)))
        either = lambda parts: "|".join(map(re.escape, parts))
        object.__setattr__(self, "_guarded", re.compile(f"(?={either([self.escape, *controls])}|(?:{either(heads) or '(?!)'})\\Z)"))
        object.__setattr__(self, "_signs", re.compile(f"{re.escape(self.escape)}.|{either(controls)}", re.DOTALL))

    def guard(self, text: str) -> str:
        """The text with the escape sign before every mark, every escape sign and a mark's beginning at its end."""
        return self._guarded.sub(lambda m: self.escape, text)

    def bare(self, text: str) -> str:
        return re.sub(f"{re.escape(self.escape)}(.)", r"\1", text, flags=re.DOTALL)

    def render(self, role: str, text: str) -> list[tuple[str, bool]]:
        """Segments of one turn; joined, they are its formatted text."""
        if role in self.marks:
            before, after = self.marks[role]
        else:
            before, after = f"{self.other[0]}{self.guard(role)}{self.other[1]}", self.other[2]
        return [(before, False), (self.guard(text), role in self.trained), (after, False)]

    def read(self, text: str) -> list[tuple[str, str]]:
        """(role, text) of every turn of a formatted text."""
        roles = {before: (role, after) for role, (before, after) in self.marks.items()}
        found, at = [], 0
        signs = ((m.start(), m.end(), m.group()) for m in self._signs.finditer(text) if not m.group().startswith(self.escape))

        def take(mark: str) -> str:
            nonlocal at
            start, end, sign = next(signs, (len(text), len(text), ""))
            if sign != mark:
                raise ValueError(f"{mark!r} expected at {start}")
            body, at = text[at:start], end
            return self.bare(body)

        for start, end, sign in signs:
            if start != at:
                raise ValueError(f"Text outside of turns at {at}")
            at = end
            if sign == self.other[0]:
                found.append((take(self.other[1]), take(self.other[2])))
            elif sign in roles:
                role, after = roles[sign]
                found.append((role, take(after)))
            else:
                raise ValueError(f"{sign!r} opens no turn")
        if at != len(text):
            raise ValueError(f"Text outside of turns at {at}")
        return found

    def states(self) -> list[str]:
        return list(dict.fromkeys(["start", *self.order, *(s for step in self.order.values() for s in step.values()), BROKEN]))

    def step(self, state: str, role: str) -> str:
        return self.order.get(state, {}).get(role, BROKEN)


#: Fixed values of a widespread chat format; the marks of assistants and of other roles are this module's own.
INSTRUCTION = Template(
    marks={"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")},
    other=("<<ROLE>>", "<</ROLE>>", "<</TURN>>"),
    trained=frozenset({"assistant"}),
    order={"start": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"},
           "assistant": {"user": "user"}},
    final=frozenset({"assistant"}),
    escape="␛")


class _Composed:
    """Composes the state maps of a conversation's pieces, in order."""

    def __init__(self):
        self.state, self.found = "start", []

    def add(self, row: dict):
        self.found.append((row["conv"], row["piece"], self.state))
        self.state = dict(row["map"])[self.state]

    def rows(self) -> list[tuple]:
        return self.found


def format_chats(conversations: DataFrame, template: Template = INSTRUCTION, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """One row per turn: conv, at (rises along a conversation), piece, segments, state after the turn, legal.

    A conversation's formatted text is its segments, joined in order of `at`; it is well formed if its last state is one
    of `template.final`. Turns out of order are formatted too, but they and all turns after them are not legal.

    Null roles and texts are empty ones; an unknown role is spelled out between marks. Null conversations are one
    conversation. Rows without a turn number come first; ties go by role, then by the text's SHA-256; repeated rows are turns of their own. An empty
    table gives no rows; other columns are not read.
    """
    blank = F.lit("")
    rows = turns.in_order(conversations.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), blank).alias("role"),
                                               F.coalesce(F.col(text), blank).alias("text")))
    kind = rows.schema["conv"].dataType.simpleString()

    def mapped(piece: list[dict]) -> list[tuple]:
        found = []
        for state in template.states():
            at = state
            for row in piece:
                at = template.step(at, row["role"])
            found.append((state, at))
        return [(piece[0]["conv"], piece[0]["piece"], piece[0]["at"], found)]

    maps = turns.by_piece(rows.select("conv", "piece", "at", "role"), mapped, f"conv {kind}, piece bigint, at bigint, map map<string,string>")
    starts = turns.by_conversation(maps, _Composed, f"conv {kind}, piece bigint, start string")

    def rendered(piece: list[dict]) -> list[tuple]:
        state, out = piece[0]["start"], []
        for row in piece:
            state = template.step(state, row["role"])
            segments = [{"text": t, "loss": loss} for t, loss in template.render(row["role"], row["text"])]
            out.append((row["conv"], row["at"], row["piece"], segments, state, state != BROKEN))
        return out

    joined = turns.join_piece(rows.select("conv", "piece", "at", "role", "text"), starts)
    return turns.by_piece(joined, rendered, f"conv {kind}, at bigint, piece bigint, segments array<struct<text:string,loss:boolean>>, state string, legal boolean")


def read_back(formatted: DataFrame, template: Template = INSTRUCTION, conv: str = "conv_id") -> DataFrame:
    """Per conversation, from the formatted rows alone: conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, state.

    Marks are read again from the joined segments. `turns_sha256` is over role, newline, text, newline of every turn, `loss_sha256` over
    all text with loss, both without escape signs. A digest needs its bytes in order: one task passes over a conversation, a row at a time.
    """
    class Read:
        def __init__(self):
            self.conv, self.turns, self.chars, self.loss, self.state = None, 0, 0, 0, "start"
            self.whole, self.trained = hashlib.sha256(), hashlib.sha256()

        def add(self, row: dict):
            self.conv, self.state = row["conv"], row["state"]
            joined = "".join(s["text"] for s in row["segments"])
            self.chars += len(joined)
            for role, text in template.read(joined):
                self.turns += 1
                self.whole.update(f"{role}\n{text}\n".encode())
            for segment in row["segments"]:
                if segment["loss"]:
                    text = template.bare(segment["text"])
                    self.loss += len(text)
                    self.trained.update(text.encode())

        def rows(self) -> list[tuple]:
            return [(self.conv, self.turns, self.whole.hexdigest(), self.loss, self.trained.hexdigest(), self.chars, self.state)]

    kind = formatted.schema["conv"].dataType.simpleString()
    schema = (f"`{conv}` {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, state string")
    return turns.by_conversation(formatted.select("conv", "at", "segments", "state"), Read, schema)
