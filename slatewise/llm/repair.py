"""Repair of turn order at least cost, with the edits as an audit string.

A dynamic program walks over a conversation's rows and keeps, for each state of the wanted form `(s?(ua)+)?`, the cheapest
audit so far and among equals the least one. Audits are persistent: an edit is a node linked to the audit before it, so all
audits of a conversation share their beginnings. Nodes know their ancestors at distances 1, 2, 4, ... and a rolling hash
of the whole audit; two audits are compared by searching their longest common prefix over these ancestors, and a prefix
that the hashes call equal is verified sign by sign.

Two audits of equal cost that reach the same state after the same rows are never one the beginning of the other: the
edits fix the states, and what one had more would be insertions, which cost. So the lesser one stays the lesser one whatever follows.

Long conversations are cut into pieces of bounded size. A piece gives the best audit from every state to every state,
and the pieces of a conversation are then put together in order.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatewise.llm import turns

BASE, MODULUS = 911_382_323, (1 << 61) - 1
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: From which states a row of this initial may follow, and the state it leads to.
STEPS = {"s": ((START,), SYSTEM), "u": ((START, SYSTEM, ASSISTANT), USER), "a": ((USER,), ASSISTANT)}
NO_FAULT, BLANK, DUPLICATE, CUT_SHORT = range(4)
SPACES = "\t\n\x0b\x0c\r "


class Audits:
    """Persistent strings: node 0 is empty, every other node is its parent's string and one sign."""

    def __init__(self, base: int = BASE, modulus: int = MODULUS):
        self.base, self.modulus = base, modulus
        self.sign, self.depth, self.hash, self.up, self.equal = [""], [0], [0], [[]], [0]
        self.collisions = 0

    def add(self, parent: int, sign: str) -> int:
        node, up, j = len(self.sign), [parent], 0
        while j < len(self.up[up[j]]):
            up.append(self.up[up[j]][j])
            j += 1
        self.sign.append(sign)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * self.base + ord(sign)) % self.modulus)
        self.up.append(up)
        self.equal.append(node)
        return node

    def ancestor(self, node: int, depth: int) -> int:
        while (distance := self.depth[node] - depth) > 0:
            node = self.up[node][distance.bit_length() - 1]
        return node

    def read(self, node: int) -> str:
        signs = []
        while node:
            signs.append(self.sign[node])
            node = self.up[node][0]
        return "".join(reversed(signs))

    def _one(self, node: int) -> int:
        """The node that stands for all nodes verified to hold the same string."""
        while self.equal[node] != node:
            self.equal[node] = self.equal[self.equal[node]]
            node = self.equal[node]
        return node

    def _verified(self, a: int, b: int) -> bool:
        """Whether two nodes of one depth hold the same string; walks back no further than to strings known to be equal."""
        path = []
        while (one := self._one(a)) != (other := self._one(b)):
            if self.sign[a] != self.sign[b]:
                return False
            path.append((one, other))
            a, b = self.up[a][0], self.up[b][0]
        for one, other in path:
            self.equal[self._one(one)] = self._one(other)
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether the string of `a` comes before the string of `b`."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, depth), self.ancestor(b, depth)
        if self.hash[x] == self.hash[y] and self._verified(x, y):
            return self.depth[a] < self.depth[b]
        p, q = x, y
        for j in reversed(range(len(self.up[x]))):
            if j < len(self.up[p]) and self.hash[self.up[p][j]] != self.hash[self.up[q][j]]:
                p, q = self.up[p][j], self.up[q][j]
        before, after = self.up[p][0], self.up[q][0]
        if self.hash[p] != self.hash[q] and self.hash[before] == self.hash[after] and self._verified(before, after):
            return self.sign[p] < self.sign[q]
        self.collisions += 1
        return self.read(a) < self.read(b)


def _better(audits: Audits, old: tuple[int, int] | None, cost: int, parent: int, sign: str) -> tuple[int, int]:
    """The better of an audit (cost, node) and another one with one more edit."""
    if old is None or cost < old[0]:
        return cost, audits.add(parent, sign)
    if cost > old[0]:
        return old
    node = audits.add(parent, sign)
    return (cost, node) if audits.less(node, old[1]) else old


def _inserted(audits: Audits, best: dict) -> dict:
    """Audits by state after any insertions that pay: an empty user, then an empty assistant."""
    out = dict(best)
    for source, target in ((START, USER), (SYSTEM, USER), (ASSISTANT, USER), (USER, ASSISTANT)):
        if source in out:
            out[target] = _better(audits, out.get(target), out[source][0] + INSERT, out[source][1], "I")
    return out


def walk(audits: Audits, rows: list[tuple[str, int]], entry: int) -> dict[int, tuple[int, int]]:
    """Best (cost, audit) by state after rows of (initial, fault), from state `entry`."""
    best = {entry: (0, 0)}
    for initial, fault in rows:
        best, new = _inserted(audits, best), {}
        extra = TRUNCATED if fault == CUT_SHORT else 0
        for state, (cost, node) in best.items():
            new[state] = _better(audits, new.get(state), cost + DELETE, node, "D")
            if fault in (BLANK, DUPLICATE):
                continue
            for role in "sua":
                sources, target = STEPS[role]
                if state in sources and (role == initial or role != "s"):
                    keep = role == initial
                    new[target] = _better(audits, new.get(target), cost + extra + (0 if keep else REROLE), node, "K" if keep else "R")
        best = new
    return best


def repaired(rows: list[dict], entry: int, audit: str) -> list[tuple[int, str, str]]:
    """(place of the row that the edit stands at, role, text) of what `audit` makes of rows, from state `entry`."""
    out, state, i = [], entry, 0
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        row = rows[min(i, len(rows) - 1)]
        due = "assistant" if state == USER else "user"
        role, text = (due, "") if edit == "I" else (due if edit == "R" else row["role"], row["text"])
        state = STEPS[due[0] if edit != "K" else row["role"][0]][1]
        out.append((row["at"], role, text))
        i += edit != "I"
    return out


def last_sign(text: Column) -> Column:
    """The last sign that is no white space, '' without one."""
    return F.right(F.rtrim(text, F.lit(SPACES)), F.lit(1))


def _piece(rows: list[dict]) -> list[tuple]:
    """One row per piece: what its conversation needs to know of it."""
    audits, first, last = Audits(), rows[0], rows[-1]
    given = [(r["initial"], r["fault"]) for r in rows]
    entries = (START,) if first["at"] == first["first_at"] else range(4)
    ways = [(entry, state, cost, audits.read(node)) for entry in entries for state, (cost, node) in walk(audits, given, entry).items()]
    faults = [sum(r["fault"] == kind for r in rows) for kind in (BLANK, DUPLICATE, CUT_SHORT)]
    illegal = sum(a["initial"] + b["initial"] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    numbers = [r["turn"] for r in rows if r["turn"] is not None]
    distinct = sum(a != b for a, b in zip([None, *numbers], numbers, strict=False))
    return [(first["conv"], first["piece"], first["at"], first["initial"], last["initial"], numbers[0] if numbers else None,
             numbers[-1] if numbers else None, distinct, *faults, illegal, [dict(zip(("entry", "state", "cost", "audit"), w, strict=True)) for w in ways])]


class _Joined:
    """Puts the pieces of a conversation together, in order."""

    def __init__(self):
        self.conv, self.best = None, {START: (0, ())}
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.initial = self.low = self.high = None

    def add(self, row: dict):
        self.conv = row["conv"]
        for name in ("blank", "duplicate", "truncated", "illegal", "distinct"):
            setattr(self, name, getattr(self, name) + row[name])
        if self.initial is not None:
            self.illegal += self.initial + row["first_initial"] not in ("su", "ua", "au")
        self.initial = row["last_initial"]
        if row["low"] is not None:
            self.distinct -= self.high == row["low"]
            self.low = row["low"] if self.low is None else self.low
            self.high = row["high"]
        new: dict = {}
        for way in row["ways"]:
            if way["entry"] in self.best:
                cost, parts = self.best[way["entry"]]
                made = (cost + way["cost"], (*parts, (row["piece"], way["entry"], way["audit"])))
                new[way["state"]] = min((made, new.get(way["state"], made)), key=_text)
        self.best = new

    def rows(self) -> list[tuple]:
        ends = []
        for state, (cost, parts) in self.best.items():
            piece, entry, audit = parts[-1]
            added = {USER: ("I",), SYSTEM: ("II",), START: ("",), ASSISTANT: ("",)}[state]
            ends += [(cost + INSERT * len(more), (*parts[:-1], (piece, entry, audit + more))) for more in added]
        cost, parts = min(ends, key=_text)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        pieces = [{"piece": p, "entry": e, "audit": a} for p, e, a in parts]
        return [(self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(a for _, _, a in parts), pieces)]


def _text(made: tuple) -> tuple[int, str]:
    return made[0], "".join(audit for _, _, audit in made[1])


class _Hashed:
    def __init__(self):
        self.conv, self.digest, self.any = None, hashlib.sha256(), False

    def add(self, row: dict):
        self.conv = row["conv"]
        for turn in row["turns"]:
            self.digest.update(f"{chr(10) if self.any else ''}{turn['role']}:{turn['text']}".encode())
            self.any = True

    def rows(self) -> list[tuple]:
        return [(self.conv, self.digest.hexdigest())]


COUNTS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def repair(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Audits and repaired turns of conversations whose roles' initials are to read `(s?(ua)+)?`.

    The first table has a row per conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit. The second has its
    repaired turns, as arrays of (role, text) per piece: conv, at, piece, turns; `at` gives their order.

    Null roles and texts count as one space; null conversations are one conversation. Rows go by turn, nulls first, ties by role, then by the text's
    SHA-256. Repeated rows are duplicates. Turn numbers are whole; an empty table gives no rows; other columns are not read.
    """
    space = F.lit(" ")
    rows = turns.in_order(conversations.select(F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("turn"), F.coalesce(F.col(role), space).alias("role"),
                                               F.coalesce(F.col(text), space).alias("text")))
    kind = rows.schema["conv"].dataType.simpleString()
    firsts = rows.groupBy("conv", "role", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("fresh"))
    last = F.col("last")
    fault = (F.when(last == "", BLANK).when(F.col("fresh").isNull(), DUPLICATE).when(last.isin(".", "!", "?"), NO_FAULT).otherwise(CUT_SHORT))
    short = rows.select("conv", "piece", "at", "turn", F.substring("role", 1, 1).alias("initial"), last_sign(F.col("text")).alias("last"))
    short = short.join(firsts, "at", "left").select("conv", "piece", "at", "turn", "initial", fault.alias("fault"))
    begun = rows.groupBy("conv").agg(F.min("at").alias("first_at"), F.min("piece").alias("piece"))
    first_at = begun.withColumnsRenamed({"conv": "_conv", "piece": "_piece"})
    marked = short.join(first_at, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("piece") == F.col("_piece")), "left").drop("_conv", "_piece")
    pieces = turns.by_piece(marked, _piece, f"conv {kind}, piece bigint, at bigint, first_initial string, last_initial string, low bigint, high bigint, "
                            "distinct bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
                            "ways array<struct<entry:int,state:int,cost:bigint,audit:string>>")
    found = turns.written(turns.by_conversation(pieces, _Joined, f"conv {kind}, {COUNTS}, pieces array<struct<piece:bigint,entry:int,audit:string>>"), "audits")
    chosen = found.select("conv", F.explode("pieces").alias("p")).select("conv", "p.*")

    def mended(some: list[dict]) -> list[tuple]:
        made = repaired(some, some[0]["entry"], some[0]["audit"])
        return [(some[0]["conv"], some[0]["at"], some[0]["piece"], [{"role": r, "text": t} for _, r, t in made])]

    joined = turns.join_piece(rows.select("conv", "piece", "at", "role", "text"), chosen)
    return found.drop("pieces").withColumnRenamed("conv", conv), turns.by_piece(
        joined, mended, f"conv {kind}, at bigint, piece bigint, turns array<struct<role:string,text:string>>")


def digests(mended: DataFrame, conv: str = "conv_id") -> DataFrame:
    """SHA-256 of each conversation's repaired `role:text`, joined by newlines; a digest needs its bytes in order, a piece at a time."""
    kind = mended.schema["conv"].dataType.simpleString()
    return turns.by_conversation(mended, _Hashed, f"`{conv}` {kind}, repaired_sha256 string")


def damage(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows of conversations (conv, turn, role, text) with faults put in by a checksum of conversation and turn; nulls are one space there.

    Of 20 remainders 0 drops the row, 1 empties its text, 2 takes its `[.!?]` away, 3 repeats it, 4 makes its role user.
    """
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, turn)))
    code = F.crc32(name.cast("binary")) % 20
    t, r = F.coalesce(F.col(text), F.lit(" ")), F.coalesce(F.col(role), F.lit(" "))
    changed = F.when(code == 1, "").when(code == 2, F.regexp_replace(t, "[.!?]", "")).otherwise(t)
    return conversations.filter(code != 0).select(
        F.col(conv), F.col(turn), F.when(code == 4, "user").otherwise(r).alias(role), changed.alias(text),
        F.explode(F.when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")
