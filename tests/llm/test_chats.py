"""Chat formatting: exact round trips, turn order over many pieces, the registered query's digests, odd rows and clashing columns."""

import hashlib
import random

import pytest

from slatewise.llm import chats, turns

SCHEMA = "conv_id bigint, turn bigint, role string, text string, conv string, at int, piece int, state string, segments string"


def made(rng):
    bits = ["<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "<<ROLE>>", "<</TURN>>", "␛", "<", "<<", "[", "/", "S", " ok ", "é😀\n", "<</", "[IN"]
    rows = []
    for conv in range(30):
        roles = (["system"] if rng.random() < 0.3 else []) + ["user", "assistant"] * rng.randint(0, 4)
        if rng.random() < 0.4 and roles:
            roles[rng.randrange(len(roles))] = rng.choice(["tool", "user", "assistant", "", None, "<s>", "a[INST"])
        rows += [(conv, t, r, rng.choice([None, "", *["".join(rng.choices(bits, k=rng.randint(0, 9))) for _ in range(6)]])) for t, r in enumerate(roles)]
    rows += [(None, None, None, None), (None, 1, "user", "x"), (50, 3, "user", "b"), (50, 3, "user", "a"), (50, 3, "assistant", "c"), (50, None, "system", "s"),
             rows[4], rows[4], (60, 1, "user", "long " * 50_000), (60, 2, "assistant", "long " * 50_000)]
    return [(*r, "x", 1, 2, "y", "z") for r in rows]


def plain(rows, template):
    groups = {}
    for conv, turn, role, text, *_ in rows:
        groups.setdefault(conv, []).append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    for conv, found in groups.items():
        found = [(r, t) for _, _, r, _, t in sorted(found)]
        state, states = "start", []
        for role, _ in found:
            state = template.order.get(state, {}).get(role, "broken")
            states.append(state)
        yield conv, found, states


@pytest.mark.parametrize("size", [4096, 3])
def test_formatting(spark, monkeypatch, size):
    monkeypatch.setattr(turns, "PIECE_ROWS", size)
    rows = made(random.Random(31))
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    formatted = chats.format_chats(table).collect()
    back = {r.conv_id: r for r in chats.read_back(spark.createDataFrame(formatted)).collect()}
    template, hashed = chats.INSTRUCTION, lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv, found, states in plain(rows, template):
        mine = sorted((r for r in formatted if r.conv == conv), key=lambda r: r.at)
        assert [r.state for r in mine] == states and [r.legal for r in mine] == [s != "broken" for s in states]
        joined = "".join(s.text for r in mine for s in r.segments)
        assert template.read(joined) == found
        loss = "".join(t for r, t in found if r == "assistant")
        r = back[conv]
        assert (r.n_turns, r.turns_sha256) == (len(found), hashed("".join(f"{a}\n{b}\n" for a, b in found)))
        assert (r.loss_chars, r.loss_sha256, r.formatted_chars, r.state) == (len(loss), hashed(loss), len(joined), states[-1])
    assert len(back) == len({r[0] for r in rows})
    empty = chats.format_chats(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and chats.read_back(empty).count() == 0


def test_texts_survive_any_marks():
    rng, template = random.Random(32), chats.INSTRUCTION
    signs = "<>[]/SYINT␛so O"
    for _ in range(5000):
        found = [(rng.choice(["user", "assistant", "system", "tool<", ""]), "".join(rng.choices(signs, k=rng.randint(0, 12)))) for _ in range(rng.randint(0, 4))]
        joined = "".join(t for r, x in found for t, _ in template.render(r, x))
        assert template.read(joined) == found
        for _, text in found:
            assert template.bare(template.guard(text)) == text
    assert template.guard("a < b, [1], </b>") == "a < b, [1], </b>"
    for bad in ("x", "<s>a", "<s>a[/INST]", "</s>", "<s></s>x"):
        with pytest.raises(ValueError):
            template.read(bad)


def test_templates_are_checked():
    base = {"trained": frozenset(), "order": {}, "final": frozenset(), "escape": "␛", "other": ("<o>", "<p>", "<q>")}
    for marks in ({"user": ("", "</u>")}, {"user": ("<u>", "<u>x")}, {"user": ("<u>", "e"), "assistant": ("<u>", "f")}, {"user": ("␛u", "e")}):
        with pytest.raises(ValueError):
            chats.Template(marks=marks, **base)
