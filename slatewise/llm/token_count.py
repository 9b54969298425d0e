"""Token counts by a compiled finite-state tokenizer.

A piece vocabulary with merges by rank is compiled, transition by transition as texts need them, into a deterministic
transducer over characters. A state holds what later merges can still depend on: the pending prefix of a longer piece
and, for each place inside it, the last piece of the tokenization that ends there with its count relative to now. Each
transition carries the change of the number of emitted tokens, so a count is the sum along a path.

Texts are cut into chunks. A place between two characters that no piece holds side by side is a certain token boundary:
from there on a chunk's state map is constant, so all chunks run in lock step from their first boundary without knowing
what stands before. The prefix scan then passes exit states on as entries of the following chunks and runs only the
heads; chunks without any boundary apply their map to the entry they get.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.llm.texts import map_texts

CHUNK = 256
PIECE_SYMBOLS = 1 << 20
HOT_COLUMNS = 128
MOST_STATES = 250_000
SPACE = "▁"


class PieceModel:
    """Pieces and ranks of a merge model with byte fallback, read from a model file of the public library."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb
        proto = pb.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback:
            raise ValueError("A merge model with byte fallback is needed")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("Only models that leave texts as they are, but for the space sign, are supported")
        if any(p.type == 4 for p in proto.pieces):
            raise ValueError("Models with user-defined pieces are not supported")
        self.prefix = spec.add_dummy_prefix
        self.rank = {p.piece: -p.score for p in proto.pieces if p.type == 1}

    def merge(self, text: str) -> list[str]:
        """Plain merging of a short text: the definition that transitions are compiled from."""
        parts = list(text)
        while len(parts) > 1:
            ranked = [(self.rank.get(a + b, np.inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, i = min(ranked)
            if rank == np.inf:
                break
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts


class Transducer:
    """Deterministic transducer of a `PieceModel`; transitions are compiled on first use and kept in a bounded table."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.pieces = {p for p in model.rank if model.merge(p) == [p]}
        self.prefixes = {p[:i] for p in self.pieces for i in range(1, len(p))}
        self.pairs = {p[i:i + 2] for p in model.rank for i in range(len(p) - 1)}
        letters = sorted({c for p in model.rank for c in p} | {SPACE})
        self.letter = np.zeros(0x110000, np.int16)
        for i, c in enumerate(letters, 1):
            self.letter[ord(c)] = i
        self.letter[ord(" ")] = self.letter[ord(SPACE)]
        self.joined = np.zeros((len(letters) + 1,) * 2, bool)
        for pair in self.pairs:
            self.joined[self.letter[ord(pair[0])], self.letter[ord(pair[1])]] = True
        self.signs = [""] + letters
        uses = np.bincount([int(self.letter[ord(c)]) for p in model.rank for c in set(p)], minlength=len(self.signs))
        self.common = np.argsort(-uses, kind="stable")[:HOT_COLUMNS - 5]
        self.valid: dict[tuple[str, str], bool] = {}
        self.clear()

    def clear(self) -> None:
        """Forget all compiled states (they come back on demand)."""
        self.states = [("", ((0, None, 0),))]
        self.ids = {self.states[0]: 0}
        self.rows = 1024
        self.table = np.full(self.rows * HOT_COLUMNS, -1, np.int32)
        self.table[::HOT_COLUMNS] = (np.arange(self.rows) << 7) + 64
        # Columns: end of lane, characters without a letter by their UTF-8 length, the commonest letters of pieces
        # (their transitions lie in the dense table), then other letters as they come.
        self.columns = np.full(len(self.signs), -1, np.int32)
        self.columns[self.common] = np.arange(5, 5 + len(self.common))
        self.column_sign: list[str | int] = [0, 1, 2, 3, 4, *(self.signs[i] for i in self.common)]
        self.rare: dict[tuple[int, int], int] = {}

    def _weight(self, piece: str) -> int:
        return 1 if piece in self.model.rank else len(piece.encode())

    def _fits(self, left: str, right: str) -> bool:
        key = (left, right)
        found = self.valid.get(key)
        if found is None:
            if len(self.valid) > 1_000_000:
                self.valid.clear()
            found = self.valid[key] = self.model.merge(left + right) == [left, right]
        return found

    def _compile(self, state: int, column: int) -> int:
        sign = self.column_sign[column]
        if isinstance(sign, int):
            return 64 + sign
        pending, places = self.states[state]
        if pending and pending[-1] + sign not in self.pairs:
            pending, places = self.states[0]
        text = pending + sign
        for back, last, count in places:
            piece = text[len(text) - back - 1:]
            if (piece in self.pieces or len(piece) == 1) and (last is None or self._fits(last, piece)):
                delta = count + self._weight(piece)
                break
        else:
            raise AssertionError(f"No piece ends {text!r}")
        kept = [(back + 1, last, count - delta) for back, last, count in places if text[len(text) - back - 1:] in self.prefixes]
        if kept:
            longest = max(back for back, _, _ in kept)
            target = (text[len(text) - longest:], ((0, piece, 0), *kept))
            number = self.ids.get(target)
            if number is None:
                number = self.ids[target] = len(self.states)
                self.states.append(target)
                if number >= self.rows:
                    grown = np.full(self.rows * HOT_COLUMNS, -1, np.int32)
                    grown[::HOT_COLUMNS] = (np.arange(self.rows, 2 * self.rows) << 7) + 64
                    self.table, self.rows = np.concatenate([self.table, grown]), 2 * self.rows
        else:
            number = 0
        return (number << 7) + 64 + delta

    def _columns(self, points: np.ndarray, letters: np.ndarray) -> np.ndarray:
        columns = self.columns[letters]
        new = np.unique(letters[(columns < 0) & (letters > 0)])
        for x in new:
            self.columns[x] = len(self.column_sign)
            self.column_sign.append(self.signs[x])
        if len(new):
            columns = self.columns[letters]
        other = letters == 0
        if other.any():
            p = points[other]
            columns[other] = 1 + (p > 0x7F) + (p > 0x7FF) + (p > 0xFFFF)
        return columns

    def run(self, columns: np.ndarray, starts: np.ndarray, lengths: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit state and token count of many stretches at once, one symbol of each per step."""
        order = np.argsort(-lengths, kind="stable")
        state, count = entry[order].astype(np.int64), np.zeros(len(order), np.int64)
        first, size = starts[order], lengths[order]
        alive = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
        for step, n in enumerate(alive):
            column = columns[first[:n] + step]
            key = state[:n] * HOT_COLUMNS + column
            rare = np.flatnonzero(column >= HOT_COLUMNS)
            if len(rare):
                key[rare] = 0
                value = self.table[key]
                value[rare] = [self.rare.get(pair, -1) for pair in zip(state[rare].tolist(), column[rare].tolist())]
            else:
                value = self.table[key]
            missing = np.flatnonzero(value < 0)
            if len(missing):
                done: dict[tuple[int, int], int] = {}
                for i in missing:
                    pair = (int(state[i]), int(column[i]))
                    if pair not in done:
                        done[pair] = made = self._compile(*pair)
                        if pair[1] < HOT_COLUMNS:
                            self.table[pair[0] * HOT_COLUMNS + pair[1]] = made
                        else:
                            self.rare[pair] = made
                    value[i] = done[pair]
            state[:n] = value >> 7
            count[:n] += (value & 127) - 64
        out_state, out_count = np.empty_like(state), np.empty_like(count)
        out_state[order], out_count[order] = state, count
        return out_state, out_count

    def chunk_counts(self, points: np.ndarray, first: np.ndarray, carry: int = 0) -> tuple[np.ndarray, int]:
        """Token count of each text in `points`, where texts begin at `first`; `carry` is the entry state of the first one."""
        letters = self.letter[points].astype(np.int64)
        columns = self._columns(points, letters)
        size = np.diff(np.append(first, len(points)))
        chunks = -(-size // CHUNK)
        owner = np.repeat(np.arange(len(first)), chunks)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        start = first[owner] + inner * CHUNK
        stop = np.minimum(start + CHUNK, first[owner] + size[owner])
        cut = np.ones(len(points) + 1, bool)
        cut[1:-1] = ~self.joined[letters[:-1], letters[1:]]
        opening = inner == 0
        place = np.flatnonzero(cut)
        sync = np.minimum(place[np.searchsorted(place, start)], stop)
        sync[opening] = start[opening]
        if carry and len(start):
            sync[0] = stop[0]
        exit_state, count = self.run(columns, sync, stop - sync, np.zeros(len(start), np.int64))
        # The scan: a chunk with a boundary has a constant exit, so its successor's entry is known at once.
        known = sync < stop
        head = sync > start
        waiting = np.flatnonzero(head)
        while len(waiting):
            ready = (waiting == 0) | known[np.maximum(waiting - 1, 0)]
            now = waiting[ready]
            entry = np.where(now == 0, carry, exit_state[np.maximum(now - 1, 0)])
            passed, tokens = self.run(columns, start[now], sync[now] - start[now], entry)
            count[now] += tokens
            whole = ~known[now]
            exit_state[now[whole]] = passed[whole]
            known[now] = True
            waiting = waiting[~ready]
        total = np.bincount(owner, count, len(first)).astype(np.int64)
        return total, int(exit_state[-1]) if len(exit_state) else carry

    def counts(self, texts: list[str]) -> list[int]:
        """Number of tokens of each whole text."""
        out, group, used = [0] * len(texts), [], 0
        prefix = SPACE if self.model.prefix else ""
        for i, text in enumerate(texts):
            if len(text) >= PIECE_SYMBOLS:
                out[i] = self._long(prefix + text)
            elif text:
                if used + len(text) >= PIECE_SYMBOLS:
                    self._group(texts, group, prefix, out)
                    group, used = [], 0
                group.append(i)
                used += len(text) + 1
        self._group(texts, group, prefix, out)
        return out

    def _trim(self) -> None:
        if len(self.states) > MOST_STATES or len(self.rare) > 2_000_000:
            self.clear()

    def _group(self, texts, group, prefix, out) -> None:
        if not group:
            return
        self._trim()
        parts = [prefix + texts[i] for i in group]
        points = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        found, _ = self.chunk_counts(points, np.cumsum(sizes) - sizes)
        for i, n in zip(group, found.tolist()):
            out[i] = n

    def _long(self, text: str) -> int:
        total, state = 0, 0
        self._trim()
        for at in range(0, len(text), PIECE_SYMBOLS):
            points = np.frombuffer(text[at:at + PIECE_SYMBOLS].encode("utf-32-le"), np.uint32)
            found, state = self.chunk_counts(points, np.zeros(1, np.int64), state)
            total += int(found[0])
        return total


_compiled: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """The transducer of a model file, compiled once in each process."""
    if path not in _compiled:
        _compiled[path] = Transducer(PieceModel(path))
    return _compiled[path]


def count_tokens(docs: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
                 limit: int | None = None) -> DataFrame:
    """`keep` with n_bytes (UTF-8), n_tokens and, with a limit, over_limit (more tokens than `limit`).

    One row per input row, so repeated rows and null ids stay; a null or empty text has 0 bytes and 0 tokens; an empty
    table gives no rows; other columns of `docs` are not read. Special strings in texts are ordinary text.
    """
    def run(texts, rows):
        return [[len(t.encode()) for t in texts], transducer(model).counts(texts)]

    out = map_texts(docs, text, run, "n_bytes bigint, n_tokens bigint", keep)
    return out if limit is None else out.withColumn("over_limit", F.col("n_tokens") > limit)
