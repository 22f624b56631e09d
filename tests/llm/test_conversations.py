"""Repair of conversations against a plain search over whole strings of edits."""

import hashlib
import random
import zlib

import pytest

from recollect.llm import conversations as cv

BLANK = " \t\n\x0b\x0c\r"
MADE_UP = {"": "u", "s": "u", "u": "a", "a": "u"}


def legal(initials: str) -> bool:
    rest = initials[1:] if initials[:1] == "s" else initials
    return not initials or (len(rest) >= 2 and len(rest) % 2 == 0 and all(c == "ua"[i % 2] for i, c in enumerate(rest)))


def plain(rows: list[tuple]) -> dict:
    """Faults and the best repair of one conversation's (turn, role, text) in order: every prefix of edits is kept by what it has made."""
    seen, faults = set(), []
    for _, role, text in rows:
        end = text.rstrip(BLANK)
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    # (what may follow: the made initials' last one and whether any) -> (cost, letters, made rows)
    best = {"": (0, "", ())}

    def goes(last: str, x: str) -> bool:
        return x == "s" and last == "" or x == "u" and last in ("", "s", "a") or x == "a" and last == "u"

    def insertions(now: dict) -> dict:
        out = dict(now)
        for last, (cost, letters, made) in now.items():
            for _ in range(3):
                last = MADE_UP[last]
                cost, letters, made = cost + 5, letters + "I", (*made, ("user" if last == "u" else "assistant", ""))
                if last not in out or (cost, letters) < out[last][:2]:
                    out[last] = cost, letters, made
        return out

    for (_, role, text), fault in zip(rows, faults):
        after: dict = {}

        def offer(last, cost, letters, made, after=after):
            if last not in after or (cost, letters) < after[last][:2]:
                after[last] = cost, letters, made

        for last, (cost, letters, made) in insertions(best).items():
            offer(last, cost + 2, letters + "D", made)
            if fault in ("blank", "duplicate"):
                continue
            more = 5 * (fault == "truncated")
            if role[:1] and goes(last, role[0]):
                offer(role[0], cost + more, letters + "K", (*made, (role, text)))
            for x in ("user", "assistant"):
                if goes(last, x[0]):
                    offer(x[0], cost + more + 1, letters + "R", (*made, (x, text)))
        best = after
    cost, audit, made = min(v for last, v in insertions(best).items() if last in ("", "a"))
    assert legal("".join(r[:1] for r, _ in made))
    turns = [t for t, _, _ in rows if t is not None]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])),
        "cost": cost,
        "audit": audit,
        "repaired": "\n".join(f"{r}:{t}" for r, t in made),
    }


def all_letters(rows: list[tuple], faults: list[str]) -> tuple[int, str]:
    """The best edits by trying all, for a few rows."""
    found = []

    def go(i: int, last: str, cost: int, letters: str, made_up: int) -> None:
        if i == len(rows) and last in ("", "a"):
            found.append((cost, letters))
        if made_up < 3:
            go(i, MADE_UP[last], cost + 5, letters + "I", made_up + 1)
        if i == len(rows):
            return
        go(i + 1, last, cost + 2, letters + "D", 0)
        if faults[i] in ("blank", "duplicate"):
            return
        more = 5 * (faults[i] == "truncated")
        for x, letter, price in ((rows[i][1][:1], "K", 0), ("u", "R", 1), ("a", "R", 1)):
            if x == "s" and last == "" or x == "u" and last in ("", "s", "a") or x == "a" and last == "u":
                go(i + 1, x, cost + more + price, letters + letter, 0)

    go(0, "", 0, "", 0)
    return min(found)


def in_order(rows: list[tuple]) -> list[tuple]:
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))


def expected(table: list[tuple], harm: bool) -> dict:
    by: dict = {}
    for conv, turn, role, text in table:
        mine = by.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if harm else 9
        if h == 0:
            continue
        text = "" if h == 1 else "".join(c for c in text if c not in ".!?") if h == 2 else text
        mine += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return {c: plain(in_order(rows)) for c, rows in by.items()}


def random_table(rng: random.Random, convs: int, most: int) -> list[tuple]:
    out = []
    for c in range(convs):
        for t in range(rng.randint(1, most)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            text = rng.choice(["One.", "Two?", "Three", " ", "", None, "Four!\n", "é ü. ", f"text {rng.random()}."])
            out.append((c, rng.choice([t, t, t, t + 1, None]), role, text))
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


def got(spark, tmp_path, table, schema=SCHEMA):
    spark.createDataFrame(table, schema).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    return {r["conv_id"]: r.asDict() for r in cv.op13_conversation_repair(spark, str(tmp_path)).collect()}


def same(found: dict, wanted: dict) -> None:
    assert found.keys() == wanted.keys()
    for c, w in wanted.items():
        w = dict(w, conv_id=c, repaired_sha256=hashlib.sha256(w["repaired"].encode()).hexdigest())
        del w["repaired"]
        assert found[c] == w, c


def test_plain_search_finds_the_best_of_all():
    rng = random.Random(5)
    for _ in range(300):
        rows = [(t, rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["A.", "B.", "c", ""])) for t in range(rng.randint(0, 5))]
        out = plain(rows)
        seen, faults = set(), []
        for _, role, text in rows:
            faults.append("blank" if not text else "duplicate" if (role, text) in seen else "truncated" if text[-1] != "." else "")
            seen.add((role, text))
        assert (out["cost"], out["audit"]) == all_letters(rows, faults)


def test_repair_equals_plain_search(spark, tmp_path):
    table = random_table(random.Random(1), 300, 12)
    same(got(spark, tmp_path, table), expected(table, True))


@pytest.mark.parametrize("size", [1, 3])
def test_long_conversations_in_stretches(spark, size):
    rng = random.Random(2)
    table = random_table(rng, 20, 10) + [(99, t, rng.choice(["user", "assistant", "system"]), rng.choice(["x.", f"y{t}.", "z", ""])) for t in range(400)]
    summary, repaired = cv.repair(spark.createDataFrame(table, SCHEMA).repartition(3), stretch=size)
    hashes = {r.conv: r.repaired_sha256 for r in cv.digests(repaired).collect()}
    found = {r.conv_id: r.asDict() | {"repaired_sha256": hashes.get(f"={r.conv_id}", hashlib.sha256().hexdigest())} for r in summary.collect()}
    same(found, expected(table, False))


def test_one_conversation_over_many_tasks(spark):
    """A conversation that all tasks share, with a row that repeats thousands of times."""
    rng = random.Random(3)
    table = [(None, t, rng.choice(["user", "assistant"]), rng.choice(["x.", f"y{t}.", "z"])) for t in range(3000)] + [(None, 7, "user", "again.")] * 3000
    summary, repaired = cv.repair(spark.createDataFrame(table, SCHEMA).repartition(4))
    want = expected(table, False)[None]
    (row,) = summary.collect()
    assert {c: row[c] for c in (*cv.SUMMARY, "audit")} == {c: want[c] for c in (*cv.SUMMARY, "audit")}
    lines = [f"{r.role}:{r.text}" for r in sorted(repaired.collect(), key=lambda r: r.place)]
    assert "\n".join(lines) == want["repaired"]
    (digest,) = cv.digests(repaired).collect()
    assert digest.repaired_sha256 == hashlib.sha256(want["repaired"].encode()).hexdigest()


def test_odd_tables(spark, tmp_path):
    table = [(None, None, None, None), (1, None, "user", "a."), (1, None, "user", "a."), (1, 5, "assistant", "b" * 300_000 + "."), (2, 2**40, "system", "s."), (3, 1, "", "x."), (3, 2, "Über", "y.")]
    same(got(spark, tmp_path, table), expected(table, True))


def test_empty_table_and_clashing_columns(spark):
    none = spark.createDataFrame([], SCHEMA)
    summary, repaired = cv.repair(none)
    assert summary.count() == 0 and repaired.count() == 0
    rows = spark.createDataFrame([("c", 1, "user", "a.", "p"), ("c", 2, "assistant", "b.", "q")], "conv string, t long, role string, body string, audit string")
    summary, repaired = cv.repair(rows, "conv", "t", "role", "body")
    (row,) = summary.collect()
    assert (row.conv_id, row.audit, row.cost) == ("c", "KK", 0)
    assert [(r.conv_id, r.role, r.text, r.edit) for r in sorted(repaired.collect(), key=lambda r: r.place)] == [("c", "user", "a.", "keep"), ("c", "assistant", "b.", "keep")]


def test_known_repairs(spark):
    rows = [
        (1, 1, "system", "Be kind."), (1, 2, "assistant", "Hi."), (1, 3, "user", "Bye."),
        (2, 1, "user", "A."), (2, 2, "assistant", "B."), (2, 3, "user", "A."), (2, 4, "assistant", " "),
        (3, 1, "user", "half a"), (3, 2, "assistant", "C."),
    ]
    summary, repaired = cv.repair(spark.createDataFrame(rows, SCHEMA))
    found = {r.conv_id: (r.audit, r.cost, r.illegal) for r in summary.collect()}
    assert found == {1: ("KRR", 2, 1), 2: ("KKDD", 4, 0), 3: ("DD", 4, 0)}
