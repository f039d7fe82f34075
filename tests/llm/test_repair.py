import hashlib
import itertools
import random
import re
import zlib

import pytest

from lakeloom.llm import repair, turns

SCHEMA = "conv_id long, turn long, role string, text string"
PATTERN = re.compile("(s?(ua)+)?")


def damaged(data):
    """The contract's damage, a conversation to its rows (turn, role, text)."""
    by = {}
    for conv_id, turn, role, text in data:
        by.setdefault(conv_id, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv_id, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, f"{r[1]}\n{r[2]}"))
        now = []
        for turn, role, text in rows:
            code = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            row = (turn, "user" if code == 4 else role, text)
            now += [] if code == 0 else [row, row] if code == 3 else [row]
        out[conv_id] = now
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        said = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, kinds, most_inserts=4):
    """All edit sequences of a short conversation, one by one."""
    best = None
    choices = [["D"] if k in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for k in kinds]
    for edits in itertools.product(*choices):
        for n in range(most_inserts + 1):
            for places in itertools.combinations_with_replacement(range(len(rows) + 1), n):
                for roles in itertools.product(("user", "assistant"), repeat=n):
                    cost, letters, made = 5 * n, "", []
                    for i in range(len(rows) + 1):
                        for p, role in zip(places, roles, strict=True):
                            if p == i:
                                letters, made = letters + "I", [*made, (role, "")]
                        if i == len(rows):
                            break
                        e, (_, role, text) = edits[i], rows[i]
                        letters += e[0]
                        cost += {"D": 2, "K": 0, "R": 1}[e[0]] + (5 if e != "D" and kinds[i] == "truncated" else 0)
                        if e != "D":
                            made.append((role if e == "K" else {"Ru": "user", "Ra": "assistant"}[e], text))
                    if all(r for r, _ in made) and PATTERN.fullmatch("".join(r[0] for r, _ in made)) and (best is None or (cost, letters) < best[:2]):
                        best = (cost, letters, made)
    return best


def row_of(conv_id, rows, best):
    kinds = faults(rows)
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, audit, made = best
    text = "\n".join(f"{r}:{t}" for r, t in made)
    return (conv_id, gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def run(spark, data):
    df = spark.createDataFrame([(*r, "x", 1) for r in data], SCHEMA + ", part string, dropped int")
    got = [tuple(r) for r in repair.digests(repair.repair(repair.damage(df))).collect()]
    assert len({g[0] for g in got}) == len(got)
    return set(got)


def conversations(seed, count, most, roles=("system", "user", "assistant", "user", "assistant", "tool", "ux", "s", "")):
    rng = random.Random(seed)
    texts = ["Yes.", "no", "What? ", "  ", "", "Same!", "half a", "é…", "a.b", None]
    return [(c, None if rng.random() < 0.1 else rng.choice([n, n, 2 * n, -n]), rng.choice([*roles, None]), rng.choice(texts)) for c in range(count) for n in range(rng.randint(1, most))]


def test_short_conversations(spark):
    data = [*conversations(1, 150, 4), (None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (10**12, None, None, None)]
    assert run(spark, data) == {row_of(c, rows, cheapest(rows, faults(rows))) for c, rows in damaged(data).items()}
    assert run(spark, []) == set()


def test_insertions():
    """Truncated rows and lone roles, where inserting can be the cheapest."""
    rng = random.Random(5)
    for _ in range(150):
        rows = [(n, rng.choice(["user", "assistant", "system"]), rng.choice([f"{n}.", f"{n}", "same."])) for n in range(rng.randint(0, 4))]
        got = repair.solve(*map(list, zip(*rows, strict=True))) if rows else repair.solve([], [], [])
        cost, audit, made = cheapest(rows, faults(rows))
        assert (got["cost"], got["audit"], list(zip(got["role"], got["text"], strict=True))) == (cost, audit, made)


@pytest.mark.parametrize("size", [1, 7])
def test_runs_of_a_conversation_equal_the_whole(spark, monkeypatch, size):
    data = conversations(3, 12, 40) + [(99, n, ("user", "assistant")[n % 2], f"text {n % 50}{'.' * (n % 3)}") for n in range(400)]
    want = set()
    for conv_id, rows in damaged(data).items():
        solved = repair.solve(*map(list, zip(*rows, strict=True))) if rows else repair.solve([], [], [])
        want.add(row_of(conv_id, rows, (solved["cost"], solved["audit"], list(zip(solved["role"], solved["text"], strict=True)))))
    monkeypatch.setattr(turns, "RUN_ROWS", size)
    assert run(spark, data) == want


def test_hot_conversation(spark):
    data = [(7, n, ("user", "assistant")[n % 2], f"row {n % 900}.") for n in range(9000)] + [(n, 0, "user", "Hi.") for n in range(100, 200)]
    (solved,) = [r for r in run(spark, data) if r[0] == 7]
    rows = damaged(data)[7]
    whole = repair.solve(*map(list, zip(*rows, strict=True)))
    assert solved == row_of(7, rows, (whole["cost"], whole["audit"], list(zip(whole["role"], whole["text"], strict=True))))


def test_query(spark, small):
    import pyarrow.parquet as pq

    data = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in pq.read_table(f"{small}/conversations.parquet").to_pylist()]
    got = {tuple(r) for r in repair.op12_conversation_repair(spark, small).collect()}
    want = set()
    for conv_id, rows in damaged(data).items():
        solved = repair.solve(*map(list, zip(*rows, strict=True))) if rows else repair.solve([], [], [])
        want.add(row_of(conv_id, rows, (solved["cost"], solved["audit"], list(zip(solved["role"], solved["text"], strict=True)))))
    assert got == want
