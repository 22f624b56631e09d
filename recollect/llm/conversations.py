"""Repair of the structure of conversations by composed weighted automata.

Three automata meet: one accepts the rows of a conversation, one edits them
(keep, rerole, delete, insert, each with a cost and a letter), one accepts the
grammar of roles.  Their composition is expanded lazily: a state is a row and a
state of the grammar, and only those that are reached are made.  The cheapest
path is found in topological order over weights (cost, letters), compared by
cost and then by letters.

A weight of a stretch of rows says, for each two states of the grammar, the best
way from one to the other.  Stretches are composed where the rows lie, in any
number of tasks; per conversation only the weights of its stretches meet.

Letters of one stretch always end with that of a row, never with an insertion,
so none begins another of the same rows and the comparison of two does not
depend on what follows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, give_back, join_counted, spool, spread, unspool

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: States of the grammar (s?(ua)+)?: its start, after the system's turn, after the user's, after the assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
#: The turn that may be made up (inserted or reroled to) in a state, which leads to the state of the same name.
MADE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Where a kept turn leads, by state and initial.
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FINAL = (START, ASSISTANT)
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Insertions in a row that can help: a third would come back to a state.
INSERTIONS = 2
#: Rows of a stretch.
STRETCH = 1024
LEGAL = {"su", "ua", "au"}
Weights = dict[int, tuple[int, str]]


def step(best: Weights, initial: str, must_go: bool, truncated: bool) -> Weights:
    """The best ways to each state of the grammar after one more row."""
    out: Weights = {}

    def offer(state: int | None, cost: int, letters: str) -> None:
        if state is not None and (state not in out or (cost, letters) < out[state]):
            out[state] = cost, letters

    for state, (cost, letters) in best.items():
        for _ in range(INSERTIONS + 1):
            offer(state, cost + DELETE, letters + "D")
            if not must_go:
                offer(KEPT.get((state, initial)), cost + TRUNCATED * truncated, letters + "K")
                offer(MADE[state], cost + REROLE + TRUNCATED * truncated, letters + "R")
            state, cost, letters = MADE[state], cost + INSERT, letters + "I"
    return out


def ending(state: int) -> tuple[int, str]:
    """The cheapest insertions that end the conversation."""
    cost, letters = 0, ""
    while state not in FINAL:
        state, cost, letters = MADE[state], cost + INSERT, letters + "I"
    return cost, letters


def follow(state: int, letters: str, initials: Iterator[str]) -> Iterator[tuple[str, int, str]]:
    """Of each row, by its letter: what is inserted before it (initials), the state after it, its letter."""
    before = ""
    for letter in letters:
        if letter == "I":
            state = MADE[state]
            before += NAMES[state][0]
            continue
        initial = next(initials)
        state = MADE[state] if letter == "R" else KEPT[state, initial] if letter == "K" else state
        yield before, state, letter
        before = ""


class Stretch:
    """Weights, counts and distinct rows of a run of rows of one conversation."""

    def __init__(self, conv: str, at: int, starts: list[int]) -> None:
        self.conv, self.at, self.starts = conv, at, starts
        self.best = {q: {q: (0, "")} for q in starts}
        self.size = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.low = self.high = None
        self.rows: list[dict] = []

    def add(self, initial: str, turn: int | None, blank: bool, seen: bool, truncated: bool) -> None:
        self.best = {q: step(b, initial, blank or seen, truncated) for q, b in self.best.items()}
        self.blank += blank
        self.duplicate += seen and not blank
        self.truncated += truncated and not seen and not blank
        if self.size:
            self.illegal += self.last + initial not in LEGAL
        else:
            self.first = initial
        self.last, self.size = initial, self.size + 1
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn

    def record(self) -> dict:
        ways = [{"a": q, "b": to, "cost": cost, "letters": letters} for q, b in self.best.items() for to, (cost, letters) in b.items()]
        names = "conv at size blank duplicate truncated illegal turns first last low high rows".split()
        return {n: getattr(self, n) for n in names} | {"ways": ways, "distinct": len(self.rows)}


STRETCHES = (
    "conv string, at bigint, size bigint, distinct bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, first string, last string, low bigint, high bigint, "
    "rows array<struct<nth: int, turn: bigint, role: string, digest: binary>>, ways array<struct<a: int, b: int, cost: bigint, letters: string>>"
)
STRETCH_TYPE = pa.schema([
    ("conv", pa.string()), ("at", pa.int64()), *((c, pa.int64()) for c in ("size", "distinct", "blank", "duplicate", "truncated", "illegal", "turns")), ("first", pa.string()), ("last", pa.string()), ("low", pa.int64()), ("high", pa.int64()),
    ("rows", pa.list_(pa.struct([("nth", pa.int32()), ("turn", pa.int64()), ("role", pa.string()), ("digest", pa.binary())]))),
    ("ways", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("letters", pa.string())]))),
])


def in_batches(records: Iterator[dict], schema: pa.Schema, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for r in records:
        held.append(r)
        if len(held) == rows:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def compose(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Stretches of so many rows that come in order; a conversation may have begun in the task before, so the first one starts anywhere."""

    def run() -> Iterator[dict]:
        now: Stretch | None = None
        made = 0
        for batch in batches:
            for row in batch.to_pylist():
                for copy in range(row["copies"]):
                    if now is None or now.conv != row["conv"] or now.size >= most:
                        known = now is not None and now.conv == row["conv"]
                        if now is not None:
                            yield now.record()
                        starts = sorted({q for b in now.best.values() for q in b}) if known else [START] if made else list(range(STATES))
                        now = Stretch(row["conv"], (row["at"] >> 33 << 33) + made, starts)  # Spark's numbers have the task above
                        made += 1
                    if not copy:
                        now.rows.append({"nth": now.size, "turn": row["turn"], "role": row["role"], "digest": row["digest"]})
                    now.add(row["role"][:1], row["turn"], row["blank"], not row["blank"] and (copy > 0 or row["seen"]), row["truncated"])
        if now is not None:
            yield now.record()

    yield from in_batches(run(), STRETCH_TYPE)
    give_back()


SUMMARY = "gaps", "blank", "duplicate", "truncated", "illegal", "cost"
CHOICES = "conv string, at bigint, distinct bigint, state int, letters string, after string, " + ", ".join(f"{c} bigint" for c in SUMMARY) + ", audit string"
CHOICE_TYPE = pa.schema([("conv", pa.string()), ("at", pa.int64()), ("distinct", pa.int64()), ("state", pa.int32()), ("letters", pa.string()), ("after", pa.string()), *((c, pa.int64()) for c in SUMMARY), ("audit", pa.string())])


def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cheapest path of each conversation from its stretches, last one first: a row for each stretch, then one for the conversation (``at`` is null)."""

    def finish(conv: str, stretches: list[dict]) -> Iterator[dict]:
        # from the end: the best way on from each state of the grammar at each boundary
        on = {q: ending(q)[0] for q in range(STATES)}
        for s in stretches:
            ways = {}
            for w in s["ways"]:
                if w["b"] in on:
                    key = w["cost"] + on[w["b"]], w["letters"]
                    if w["a"] not in ways or key < ways[w["a"]][0]:
                        ways[w["a"]] = key, w["b"]
            s["chosen"] = ways
            on = {q: key[0] for q, (key, _) in ways.items()}
            del s["ways"]
        state, audit, total, chosen = START, [], on[START], []
        sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        last, low, high = None, None, None
        for s in reversed(stretches):
            (_, letters), to = s["chosen"][state]
            for c in sums:
                sums[c] += s[c]
            if last is not None:
                sums["illegal"] += last + s["first"] not in LEGAL
            last = s["last"]
            if s["low"] is not None:
                sums["turns"] -= s["low"] == high
                low, high = s["low"] if low is None else low, s["high"]
            audit.append(letters)
            chosen.append({"conv": conv, "at": s["at"], "state": state, "letters": letters, "after": "", "distinct": s["distinct"]})
            state = to
        # what is inserted at the end follows the last row that is no copy: copies go
        audit.append(ending(state)[1])
        for _ in audit[-1]:
            state = MADE[state]
            next(c for c in reversed(chosen) if c["distinct"])["after"] += NAMES[state][0]
        yield from chosen
        gaps = high - low + 1 - sums["turns"] if low is not None else 0
        yield {"conv": conv, "gaps": gaps, "cost": total, "audit": "".join(audit)} | {c: sums[c] for c in ("blank", "duplicate", "truncated", "illegal")}

    def run() -> Iterator[dict]:
        conv, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if held and row["conv"] != conv:
                    yield from finish(conv, held)
                    held = []
                conv = row["conv"]
                held.append(row)
        if held:
            yield from finish(conv, held)

    yield from in_batches(run(), CHOICE_TYPE)
    give_back()


EDITS = "conv string, turn bigint, role string, digest binary, before string, state int, letter string, after string"
EDIT_TYPE = pa.schema([("conv", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("digest", pa.binary()), ("before", pa.string()), ("state", pa.int32()), ("letter", pa.string()), ("after", pa.string())])


def edits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edit of each distinct row of a stretch; copies of a row are deleted and need none."""

    def run() -> Iterator[dict]:
        for batch in batches:
            for s in batch.to_pylist():
                firsts = {r["nth"]: r for r in s["rows"]}
                initials = (firsts[i]["role"][:1] if i in firsts else "" for i in range(s["size"]))
                last = max(firsts, default=None)
                for i, (before, state, letter) in enumerate(follow(s["state"], s["letters"], initials)):
                    if i in firsts:
                        r = firsts[i]
                        yield {"conv": s["conv"], "turn": r["turn"], "role": r["role"], "digest": r["digest"], "before": before, "state": state, "letter": letter, "after": s["after"] if i == last else ""}

    yield from in_batches(run(), EDIT_TYPE)
    give_back()




def in_order(df: DataFrame, *more: str) -> DataFrame:
    """``df`` dealt out and sorted by conversation, turn, role and digest: neighbours stay neighbours, a long conversation spreads."""
    keys = [F.asc("conv"), F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("digest")]
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys, *more)


def once_where_many(rows: DataFrame, units: DataFrame) -> DataFrame:
    """``rows`` without the copies of those that a large share of all rows repeats (a thousand at most); copies of others stay."""
    keys = ["conv", "turn", "role", "digest"]
    many = units.agg(F.sum("copies")).first()[0] or 0
    hot = units.filter(F.col("copies") > max(STRETCH, many / HOT_KEYS)).select(F.xxhash64(*keys).alias("name")).distinct()
    if hot.isEmpty():
        return rows
    named = rows.withColumn("name", F.xxhash64(*keys))
    rest = named.join(F.broadcast(hot), "name", "left_anti")
    return named.join(F.broadcast(hot), "name", "left_semi").dropDuplicates(keys).unionByName(rest).drop("name")


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", stretch: int = STRETCH) -> tuple[DataFrame, DataFrame]:
    """The faults and the cheapest repair of conversations: (summary, repaired).

    ``summary`` has a row for each conversation: conv_id, gaps (turns that are
    missing between the smallest and the largest), blank, duplicate, truncated
    (rows by their first fault), illegal (neighbours whose initials are not su,
    ua or au), cost, audit (letters of the edits: K, R, D, I).  ``repaired`` has
    the rows that result: conv_id, place (their order), role, text, edit.

    Rows are taken by turn, null turns first; rows of one turn by role, then by
    a digest of the text, equal ones side by side, of which all but the first
    are duplicates.  A null role or text is one space; a role whose initial is
    not s, u or a, or that is empty, can't be kept.  A null conversation is one
    like others.  Conversations without rows are in neither result; further
    columns are ignored.

    Texts are not moved for the path, only their digests; counts of equal rows
    are made before the shuffle, and a conversation of any length is dealt over
    tasks in stretches.  What meets per conversation is 16 weights for each
    stretch.
    """
    conv, turn = F.col(conv_col), F.col(turn_col).cast("bigint")
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit(" ")), F.coalesce(F.col(text_col).cast("string"), F.lit(" "))
    key = F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))
    rows = rows.select(conv.alias("conv_id"), key.alias("conv"), turn.alias("turn"), role.alias("role"), text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    end = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    units = rows.select("conv", "turn", "role", "digest", (end == "").alias("blank"), ((end != "") & ~end.isin(".", "!", "?")).alias("truncated"))
    units = spool(units.groupBy("conv", "turn", "role", "digest", "blank", "truncated").agg(F.count(F.lit(1)).alias("copies")), "units")

    # rows whose role and text came before: those of a repeated text that are not of its first turn
    same = ["conv", "role", "digest"]
    order = F.struct(F.col("turn").isNotNull().alias("has"), "turn")
    repeated = units.filter("NOT blank").groupBy(*same).agg(F.min(order).alias("earliest"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    repeated = spool(repeated, "repeated")
    flagged = join_counted(units, repeated, same).withColumn("seen", order > F.col("earliest")).drop("earliest", "n")
    flagged = flagged.unionByName(units.join(repeated, same, "left_anti").withColumn("seen", F.lit(False)))
    flagged = spool(flagged, "flagged")

    ordered = in_order(flagged).withColumn("at", F.monotonically_increasing_id())
    stretches = spool(ordered.select("conv", "turn", "role", "digest", "blank", "truncated", "seen", "copies", "at").mapInArrow(partial(compose, most=stretch), STRETCHES), "stretches")
    rows = once_where_many(rows, units)
    unspool(repeated, flagged)
    chosen = stretches.drop("rows").repartition("conv").sortWithinPartitions("conv", F.desc("at"))
    chosen = spool(chosen.mapInArrow(choose, CHOICES), "choices")
    names = rows.select("conv", "conv_id").distinct()
    summary = names.join(chosen.filter("at IS NULL"), "conv").select("conv_id", *SUMMARY, "audit")

    picked = stretches.select("conv", "at", "size", "rows").join(chosen.filter("at IS NOT NULL").select("conv", "at", "state", "letters", "after"), ["conv", "at"])
    edits = picked.mapInArrow(edits_of, EDITS)
    none = lambda kind: F.lit(None).cast(kind)
    both = edits.withColumns({"conv_id": none(rows.schema["conv_id"].dataType), "text": none("string"), "kind": F.lit(0)})
    both = both.unionByName(rows.withColumns({"before": none("string"), "state": none("int"), "letter": none("string"), "after": none("string"), "kind": F.lit(1)}))
    kind = rows.schema["conv_id"].dataType.simpleString()
    told = in_order(both, "kind").withColumn("at", F.monotonically_increasing_id() * 8)

    def realise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edit: dict = {"letter": None}
        for batch in batches:
            made: dict[str, list] = {c: [] for c in ("conv_id", "conv", "place", "role", "text", "edit")}

            def emit(row: dict, shift: int, role: str, text: str, letter: str, made: dict = made) -> None:
                for c, v in (("conv_id", row["conv_id"]), ("conv", row["conv"]), ("place", row["at"] + shift), ("role", role), ("text", text), ("edit", letter)):
                    made[c].append(v)

            for row in batch.to_pylist():
                if not row["kind"]:
                    edit = row
                    continue
                letter = edit["letter"]
                if letter is None:  # a further copy
                    continue
                for i, x in enumerate(edit["before"]):
                    emit(row, i, "user" if x == "u" else "assistant", "", "insert")
                if letter != "D":
                    emit(row, 2, row["role"] if letter == "K" else NAMES[edit["state"]], row["text"], "keep" if letter == "K" else "rerole")
                for i, x in enumerate(edit["after"]):
                    emit(row, 3 + i, "user" if x == "u" else "assistant", "", "insert")
                edit = {"letter": None}
            yield pa.RecordBatch.from_arrays([pa.array(made["conv_id"], batch.column("conv_id").type), *(pa.array(made[c], t) for c, t in (("conv", pa.string()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())))], list(made))
        give_back()

    repaired = told.mapInArrow(realise, f"conv_id {kind}, conv string, place bigint, role string, text string, edit string")
    return summary, repaired


def digests(repaired: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of the lines ``role:text`` of each conversation, one hash from first to last line, so its rows stream through one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, now = None, None
        for batch in batches:
            convs, made = [], []
            for c, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv", "role", "text"))):
                if c != conv:
                    if now is not None:
                        convs.append(conv)
                        made.append(now.hexdigest())
                    conv, now = c, hashlib.sha256()
                else:
                    now.update(b"\n")
                now.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(convs, pa.string()), pa.array(made, pa.string())], ["conv", "repaired_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.string()), pa.array([now.hexdigest()], pa.string())], ["conv", "repaired_sha256"])

    return repaired.select("conv", "place", "role", "text").repartition("conv").sortWithinPartitions("conv", "place").mapInArrow(run, "conv string, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) after the damage that the checksum of conversation and turn decides; nulls are one space."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    out = rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), (F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20).alias("harm"))
    hurt: Column = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("harm") == 0, 0).when(F.col("harm") == 3, 2).otherwise(1)
    out = out.select("conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"), hurt.alias("text"), F.explode(F.array_repeat(F.lit(0), copies)).alias("copy"))
    return out.drop("copy")


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    rows = spread(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    summary, repaired = repair(damaged(rows))
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    all_of = rows.select("conv_id").distinct().withColumn("conv", key)
    out = all_of.join(summary.withColumn("conv", key).drop("conv_id"), "conv", "left").join(digests(repaired), "conv", "left")
    return out.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in SUMMARY), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
