"""Structure repair against a search over all edits, the registered query's rows, faults, pieces, collisions, odd rows and clashing columns."""

import hashlib
import random
import re
import zlib
from functools import lru_cache
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from slatewise.llm import queries, repair, turns

SCHEMA = "conv_id bigint, turn bigint, role string, text string, conv string, at int, piece int, audit string, pieces string"
WHITE = "\t\n\x0b\x0c\r "


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(WHITE)
        out.append(1 if not bare else 2 if (role, text) in seen else 0 if bare[-1] in ".!?" else 3)
        seen.add((role, text))
    return out


def cheapest(rows):
    """Least cost and least audit by recursion from the end, where whole rests of audits are compared."""
    faults = faults_of(rows)

    @lru_cache(None)
    def rest(i, state, run):
        found = []
        if i == len(rows):
            found += [(0, "")] if state in "0a" else []
        else:
            cost, audit = rest(i + 1, state, 0)
            found.append((cost + 4, "D" + audit))
            if faults[i] not in (1, 2):
                extra = 3 * (faults[i] == 3)
                for role in "sua":
                    if state in {"s": "0", "u": "0sa", "a": "u"}[role]:
                        keep = rows[i][0][:1] == role
                        if keep or role != "s":
                            cost, audit = rest(i + 1, role, 0)
                            found.append((cost + extra + 3 * (not keep), ("K" if keep else "R") + audit))
        if run < 4:
            for role in "ua":
                if state in {"u": "0sa", "a": "u"}[role]:
                    cost, audit = rest(i, role, run + 1)
                    found.append((cost + 3, "I" + audit))
        return min(found, default=(10 ** 9, ""))
    return rest(0, "0", 0)


def apply(rows, audit):
    out, i = [], 0
    for edit in audit:
        due = "assistant" if out and out[-1][0][0] == "u" else "user"
        if edit == "I":
            out.append((due, ""))
            continue
        if edit != "D":
            out.append((rows[i][0] if edit == "K" else due, rows[i][1]))
        i += 1
    assert i == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out))
    return out


def plain(rows):
    rows = sorted(((t is not None, t or 0, r if r is not None else " ", hashlib.sha256((x if x is not None else " ").encode()).hexdigest(), x if x is not None else " ")
                   for _, t, r, x in rows))
    numbers = {n for known, n, *_ in rows if known}
    rows = [(r, x) for _, _, r, _, x in rows]
    faults = faults_of(rows)
    initials = [r[:1] for r, _ in rows]
    cost, audit = cheapest(rows)
    return (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, faults.count(1), faults.count(2), faults.count(3),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{x}" for r, x in apply(rows, audit)).encode()).hexdigest())


def made(rng, conversations):
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randint(0, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "cut", "cut \n", "", " \t", None, "a.b", f"own {turn}."])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 1, None]), role, text))
    return rows + [(None, None, None, None), (None, 4, "user", "é?"), *rows[:3]]


@pytest.mark.parametrize("size", [4096, 2])
def test_repair(spark, monkeypatch, size):
    monkeypatch.setattr(turns, "PIECE_ROWS", size)
    rows = made(random.Random(41), 150)
    table = spark.createDataFrame([(*r, "x", 1, 2, "y", "z") for r in rows], SCHEMA).repartition(3)
    audits, mended = repair.repair(table)
    hashes = {r.conv_id: r.repaired_sha256 for r in repair.digests(mended).collect()}
    found = {r.conv_id: (*r[1:], hashes[r.conv_id]) for r in audits.collect()}
    groups = {}
    for row in rows:
        groups.setdefault(row[0], []).append(row)
    assert found == {conv: plain(some) for conv, some in groups.items()}
    audits, mended = repair.repair(spark.createDataFrame([], SCHEMA))
    assert audits.count() == 0 and mended.count() == 0


def test_long_conversation(spark, monkeypatch):
    """One conversation with most rows, over many pieces, in bounded time."""
    rng = random.Random(42)
    rows = [(7, t, rng.choice(["user", "assistant"]), f"{t % 900}{rng.choice('.x')}") for t in range(12_000)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    parts = []
    for size in (4096, 500):
        monkeypatch.setattr(turns, "PIECE_ROWS", size)
        audits, mended = repair.repair(table)
        parts.append((audits.first(), repair.digests(mended).first()))
    assert parts[0] == parts[1]
    texts = [(r, x) for _, _, r, x in rows]
    faults = faults_of(texts)
    best = {"0": 0}
    for (role, _), fault in zip(texts, faults):  # least cost alone
        for a, b in (("0", "u"), ("a", "u"), ("u", "a")):
            if a in best:
                best[b] = min(best.get(b, 1e9), best[a] + 3)
        new = {s: c + 4 for s, c in best.items()}
        if fault not in (1, 2):
            for s, c in best.items():
                t = "a" if s == "u" else "u"
                new[t] = min(new.get(t, 1e9), c + 3 * (fault == 3) + 3 * (role[0] != t))
        best = new
    assert parts[0][0].cost == min(best.get("0", 1e9), best["a"], best["u"] + 3)
    apply(texts, parts[0][0].audit)


def test_audits_with_poor_hashes():
    for modulus in (2, 7, repair.MODULUS):
        rng = random.Random(43)
        audits = repair.Audits(base=3, modulus=modulus)
        nodes = [0]
        for _ in range(400):
            nodes.append(audits.add(rng.choice(nodes[-6:] + nodes[:2]), rng.choice("DIK")))
        for _ in range(3000):
            a, b = rng.choice(nodes), rng.choice(nodes)
            assert audits.less(a, b) == (audits.read(a) < audits.read(b))
        assert (audits.collisions > 0) == (modulus < 100)


def test_damage(spark):
    rows = [(c, t, "assistant", "A. b! c?") for c in range(40) for t in range(5)] + [(None, None, None, None), (1, None, None, "x.")]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    want = []
    for c, t, r, x in rows:
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = r or " ", x or " "
        x = "" if code == 1 else re.sub("[.!?]", "", x) if code == 2 else x
        want += [(c, t, "user" if code == 4 else r, x)] * (0 if code == 0 else 2 if code == 3 else 1)
    assert sorted(map(str, (tuple(r) for r in repair.damage(table).collect()))) == sorted(map(str, want))


def test_registered_query(spark, tmp_path):
    """The query on rows whose damage drops whole conversations, against plain repair."""
    rng = random.Random(44)
    rows = made(rng, 120) + [(1000 + c, t, "user" if t % 2 == 0 else "assistant", f"{t}.") for c in range(60) for t in range(1)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    table.write.parquet(str(tmp_path / "conversations.parquet"))
    groups = {r[0]: [] for r in rows}
    for r in repair.damage(table).collect():
        groups[r.conv_id].append(tuple(r))
    found = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)
             for r in queries.QUERIES["op13_structure_repair"](spark, str(tmp_path)).collect()}
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert found == {c: plain(some) if some else nothing for c, some in groups.items()}
    assert nothing in found.values()
