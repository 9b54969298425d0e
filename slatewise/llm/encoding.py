"""Exact token ids of whole texts through the tokenizers library, each distinct word encoded once per process.

A space or line break between two plain signs always ends a pre-token, so what stands on either side encodes alone to
the same ids. Arrow cuts a slice of texts into such units, numbers its distinct ones and puts their ids in place, so
Python sees each unit once per slice. Units are looked up in a bounded table; what is new goes to the library. Texts in which white space
is not of that simple kind are cut only where it is, and texts that hold a special string are encoded in one piece.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_PLAIN = "!-~À-ɏ"
_CUT = re.compile(f"(?<=[{_PLAIN}])(?: |(\n))(?=[{_PLAIN}])")
_UNIT = re.compile(f"\n\n|\n?[{_PLAIN}](?:.*[{_PLAIN}])?", re.S)
_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_ENDS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_PROBES = ("the", "Word", "élève", "ÜBER", "straße", "Internationalisation", "ñandú")
MOST_UNITS = 500_000
MOST_TAILS = 10_000
LONGEST_UNIT = 64


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, without added special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.units: dict[str, bytes] = {}
        self.passed = 0
        self.tails: dict[str, bytes] = {"": b""}
        self.model = self.library.model
        self.form = self._form()

    def _form(self):
        """How a plain word reaches the model: as bytes with a sign for the space, or in lower case; None if neither fits."""
        forms = (lambda word, spaced: ("Ġ" if spaced else "") + _letters(word), lambda word, spaced: _letters(word.lower()))
        for form in forms:
            pairs = [(" " * spaced + w + end, form(w, spaced), end) for w in _PROBES for spaced in (0, 1) for end in ("", *_ENDS, "?!)")]
            whole = self._ids([text for text, _, _ in pairs])
            if whole == [self._word(name) + (self._ids([end])[0] if end else b"") for _, name, end in pairs]:
                return form
        return None

    def _word(self, name: str) -> bytes:
        return np.array([t.id for t in self.model.tokenize(name)], "<u4").tobytes()

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _plain(self, unit: str) -> str | None:
        """The unit without the punctuation at its end if the rest is one plain word (after a line break, with it); else None."""
        core = unit.rstrip(_ENDS)
        word = core[1:] if core[:1] == "\n" else core
        return core if self.form and (word.isalpha() if word.isascii() else _WORD.fullmatch(word)) else None

    def _learn(self, names: dict[str, str | None]) -> dict[str, bytes]:
        """Ids of units, given with what `_plain` says of them: '\\n\\n' is a line break, '\\nword' begins a line, any other follows a space.

        Plain words go straight to the library's model, with or without punctuation once; the rest goes through the
        whole library in long strings, held apart by a special string that none of them contains.
        """
        made, rest = {}, []
        tokenize, tails, form, known = self.model.tokenize, self.tails, self.form, self.units.get
        for u, core in names.items():
            if core is None:
                rest.append(u)
                continue
            ids = made.get(core)
            if ids is None:
                ids = known(core)
            if ids is None:
                name = form(core[1:], False) if core[0] == "\n" else form(core, True)
                made[core] = ids = array("I", [t.id for t in tokenize(name)]).tobytes()
            if len(u) > len(core):
                tail = u[len(core):]
                end = tails.get(tail)
                if end is None:
                    if len(tails) >= MOST_TAILS:
                        tails.clear()
                    tails[tail] = end = self._ids([tail])[0]
                made[u] = ids + end
        through = dict(zip(rest, self._through(rest), strict=True))
        self.passed += len(names)
        if self.passed > 5 * MOST_UNITS:
            self.units.clear()
            self.passed = 0
        if len(self.units) < MOST_UNITS:
            self.units.update((u, b) for u, b in made.items() if len(u) <= LONGEST_UNIT)
            self.units.update((u, b) for u, b in through.items() if len(u) <= LONGEST_UNIT and _UNIT.fullmatch(u))
        return made | through

    def _through(self, names: list[str]) -> list[bytes]:
        texts = [u[1:] if u[0] == "\n" else " " + u for u in names]
        if not self.special:
            ids = self._ids(texts)
        else:
            mark, ids = self.special[0], []
            apart = self.library.token_to_id(mark)
            for at in range(0, len(texts), 2000):
                found = np.array(self.library.encode_batch_fast([mark.join(texts[at:at + 2000])], add_special_tokens=False)[0].ids, "<u4")
                ends = np.append(np.flatnonzero(found == apart), len(found)) * 4
                raw, start = found.tobytes(), 0
                for end in ends.tolist():
                    ids.append(raw[start:end])
                    start = end + 4
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        out, whole, cut = [b""] * len(texts), [], []
        for row, text in enumerate(texts):
            if any(s in text for s in self.special):
                whole.append(row)
            elif text:
                cut.append(row)
        if cut:
            self._cut(texts, cut, out)
        for row, ids in zip(whole, self._ids([texts[row] for row in whole]), strict=True) if whole else ():
            out[row] = ids
        return out

    def _cut(self, texts: list[str], rows: list[int], out: list[bytes]):
        """Put the ids of the texts at `rows`, which hold no special string and are not empty, into `out`."""
        get, plain = self.units.get, self._plain
        spread = pa.array(["\n" + texts[row].replace("\n", " \n\n \n") for row in rows], pa.large_string())
        split = pc.split_pattern(spread, " ")
        coded = split.values.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        places, bounds = coded.indices.to_numpy(), split.offsets.to_numpy()
        parts = list(map(get, names))
        gaps, odd = {}, []
        for i, part in enumerate(parts):
            if part is None:
                core = plain(names[i])
                if core is None and not _UNIT.fullmatch(names[i]):
                    odd.append(i)
                    parts[i] = b""
                else:
                    gaps[i] = core
        open_rows, new = [], {}
        if odd:
            strange = np.zeros(len(names), bool)
            strange[odd] = True
            aside = np.zeros(len(rows), bool)
            aside[np.searchsorted(bounds, np.flatnonzero(strange[places]), "right") - 1] = True
            used = np.zeros(len(names), bool)
            used[places[np.repeat(~aside, np.diff(bounds))]] = True
            for i in [i for i in gaps if not used[i]]:
                del gaps[i]
                parts[i] = b""
            for at in np.flatnonzero(aside).tolist():
                units = _careful(texts[rows[at]])
                found = list(map(get, units))
                open_rows.append((rows[at], units, found))
                new.update((u, plain(u)) for u, part in zip(units, found, strict=True) if part is None and u not in new)
        new.update((names[i], core) for i, core in gaps.items())
        made = self._learn(new) if new else {}
        for i in gaps:
            parts[i] = made[names[i]]
        _, ends, raw = pa.array(parts, pa.large_binary()).take(coded.indices).buffers()
        ends = np.frombuffer(ends, np.int64, len(places) + 1)[bounds].tolist()
        raw = raw.to_pybytes() if raw is not None else b""
        for row, start, end in zip(rows, ends, ends[1:]):
            out[row] = raw[start:end]
        for row, units, found in open_rows:
            out[row] = b"".join([made[u] if part is None else part for u, part in zip(units, found, strict=True)])


def _byte_signs() -> list[str]:
    """A visible sign for each byte: itself where it is one, else the next free code point from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


_SIGNS = "".join(_byte_signs())


def _letters(word: str) -> str:
    return word if word.isascii() else word.encode().decode("latin-1").translate(_SIGNS)


def _careful(text: str) -> list[str]:
    """Units of a text with white space of other kinds: cut only where one sign stands between plain neighbours."""
    units, start, lead = [], 0, "\n"
    for cut in _CUT.finditer(text):
        units.append(lead + text[start:cut.start()])
        if cut[1]:
            units.append("\n\n")
            lead = "\n"
        else:
            lead = ""
        start = cut.end()
    units.append(lead + text[start:])
    return units


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
