import hashlib
import itertools
import random
import zlib

import pytest

from pulseframe.llm import conversations as own
from pulseframe.llm.queries import QUERIES, SQL

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(SPACE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def right_form(initials):
    rest = initials.removeprefix("s")
    return not initials or len(rest) >= 2 and rest == "ua" * (len(rest) // 2)


def cheapest(rows):
    """(cost, edits, repaired rows): every way of editing is tried, by breadth, least first."""
    faults = faults_of(rows)
    best = None
    most = 2 * len(rows) + 2

    def walk(at, cost, edits, made):
        nonlocal best
        initials = "".join(r[:1] or "-" for r, _ in made)
        if best is not None and cost > best[0] or len(made) > most:
            return
        if not any(right_form(initials + tail) for tail in ("", "a", "ua")):
            return
        if at == len(rows) and right_form(initials) and (best is None or (cost, edits) < best[:2]):
            best = (cost, edits, list(made))
        for role in ("user", "assistant"):
            if not edits.endswith("II"):
                walk(at, cost + 2, edits + "I", [*made, (role, "")])
        if at < len(rows):
            role, text = rows[at]
            if faults[at] not in ("blank", "duplicate"):
                more = faults[at] == "truncated"
                walk(at + 1, cost + more, edits + "K", [*made, (role, text)])
                for other in ("user", "assistant"):
                    walk(at + 1, cost + more + 2, edits + "R", [*made, (other, text)])
            walk(at + 1, cost + 3, edits + "D", made)

    walk(0, 0, "", [])
    return best


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def answers(rows, damage=True):
    """What the query returns, by trying everything."""
    held = {}
    for conv, *_ in rows:
        held.setdefault(conv, [])
    spaced = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    for conv, turn, role, text in damaged(rows) if damage else spaced:
        held[conv].append((turn, role, text))
    out = []
    for conv, own_rows in held.items():
        own_rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        turns = {t for t, _, _ in own_rows if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        pairs = [(r, t) for _, r, t in own_rows]
        faults = faults_of(pairs)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(pairs))
        cost, edits, made = cheapest(pairs)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, edits, digest))
    return sorted(out, key=repr)


def some_rows(n, longest, seed, keys=None):
    draw = random.Random(seed)
    texts = ["Yes.", "No!", "Well", "Why?", " ", "", "a\nb.", "Yes.", "so so \t", "é"]
    rows = []
    for conv in range(n):
        turn = draw.choice([0, 1, -3])
        for _ in range(draw.randrange(longest + 1)):
            rows.append((conv if keys is None else keys[conv % len(keys)] and conv, draw.choice([turn, turn, turn, None]), draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), draw.choice([*texts, None])))
            turn += draw.choice([0, 1, 1, 1, 2, 5])
    return rows


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_every_signature_of_up_to_four_rows():
    """The trie's answers are those of trying all edits, in whatever company a signature comes."""
    texts = {own.SOUND: "x{}.", own.TRUNCATED: "x{}", own.BLANK: " "}
    roles = ("system", "user", "assistant", "tool")
    kinds = [(i, f) for i in range(4) for f in texts]
    some = [list(c) for n in range(3) for c in itertools.product(kinds, repeat=n)]
    draw = random.Random(4)
    some += [[draw.choice(kinds) for _ in range(draw.choice([3, 4]))] for _ in range(150)]
    trie = own.Trie()
    for signature in sorted(some, key=lambda s: bytes(i * 4 + f for i, f in s)):
        rows = [(roles[i], texts[f].format(at)) for at, (i, f) in enumerate(signature)]
        codes = bytes(i * 4 + (f if f != own.BLANK else own.BLANK) for i, f in signature)
        answer = trie.insert(codes)
        assert (answer.cost, answer.audit) == cheapest(rows)[:2], signature


def test_layers_are_shared_and_few():
    trie, draw = own.Trie(), random.Random(1)
    own.advance.cache_clear()
    signatures = sorted(bytes(draw.choice([4, 8, 7, 5, 9, 12, 0]) for _ in range(draw.randrange(60))) for _ in range(400))
    longest = trie.insert(bytes([4, 8] * 50_000))
    assert longest.cost == 0 and longest.audit == "K" * 100_000
    for s in signatures:
        trie.insert(s)
    assert own.advance.cache_info().currsize < 2000
    steps = trie.steps[:5]
    trie.insert(signatures[-1][:4] + bytes([15]))
    assert all(a is b for a, b in zip(steps, trie.steps, strict=False))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_trying_everything(spark, seed):
    rows = some_rows(60, 4, seed)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert rows_of(own.digests(own.damage(docs), ids=docs)) == answers(rows)
    assert rows_of(own.digests(docs)) == answers(rows, damage=False)


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "cut"), (1, 2, "assistant", "Ok."), (1, 2, "assistant", "Ok."), (2, 0, "assistant", "A."), (3, 0, "user", " ")]
    got = sorted(tuple(r) for r in own.repair(spark.createDataFrame(rows, SCHEMA)).collect())
    # conversation 1: deleting the cut-off row costs as much as answering it, and D comes before K
    assert got == [(1, 0, "K", "user", "Hi."), (1, 1, "K", "assistant", "Ok."), (2, 0, "I", "user", ""), (2, 1, "K", "assistant", "A.")]


def test_null_and_text_ids_clashing_columns_and_empty_tables(spark):
    rows = [(None, 3, "user", "A."), (None, 5, None, None), (None, None, "assistant", "B.")]
    schema = "conv_id string, turn int, role string, text string, code string, digest int, answer string, gaps double, signature string"
    wide = spark.createDataFrame([("x" if c is None else str(c), t, r, b, "c", 1, "a", 0.5, "s") for c, t, r, b in rows] + [(None, 1, "user", "Q?", "c", 1, "a", 0.5, "s")], schema)
    got = {r.conv_id: r for r in own.digests(wide).collect()}
    assert set(got) == {None, "x"} and got["x"].gaps == 1 and got[None].audit in ("KI", "D")
    none = spark.createDataFrame([], SCHEMA)
    assert own.digests(own.damage(none), ids=none).collect() == [] and own.repair(none).collect() == []


def test_conversations_that_lost_all_rows_remain(spark):
    lost = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    docs = spark.createDataFrame([(lost, 0, "user", "A.")] * 2, SCHEMA)
    assert rows_of(own.digests(own.damage(docs), ids=docs)) == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_one_long_conversation_and_many_alike(spark):
    long = [(0, i, "user" if i % 2 == 0 else "assistant", f"t{i}." * (i % 50)) for i in range(3000)]
    alike = [(c, i, role, "Same.") for c in range(1, 800) for i, role in enumerate(("user", "assistant"))]
    got = {r.conv_id: r for r in own.digests(spark.createDataFrame(long + alike, SCHEMA).repartition(6)).collect()}
    assert len(got) == 800 and got[0].blank == 60 and len(got[0].audit) >= 3000
    assert {r.audit for c, r in got.items() if c} == {"KK"} and {r.cost for c, r in got.items() if c} == {0}


def test_registered():
    assert "op12_conversation_repair" in QUERIES and "op12_conversation_repair" in SQL
