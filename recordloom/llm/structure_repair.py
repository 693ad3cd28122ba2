"""Conversation structure repair with Four-Russians block tables.

The turns of a conversation, in order, are to become a legal sequence of role
initials ``(s?(ua)+)?`` at the least cost. Edits: Keep costs 0, Rerole (to
user or assistant) 3, Delete 4, Insert (an empty user or assistant turn) 3; a
blank or duplicate turn must be deleted, an undeleted truncated one adds 3.

A turn is one of nine symbols. The costs of finishing from each of the four
states (start, after s, after u, after a) are a vector; normalised by its
minimum it is one of a few. For every block of ``BLOCK`` symbols and every
such vector a table holds the vector before the block and the added cost, so
a conversation is worked off from its end by one lookup a block. The edits are
then traced forward: each block is expanded backward from the vector at its
right end, and of the edits that reach the optimum the ASCII-least is taken,
which gives the least audit string among all optimal ones, whatever the ties.

Only symbols (a byte a turn) are held per conversation. The texts pass once,
sorted, behind their conversation's audit, and are never held.

Defined cases: a null role or text is one blank; a null conversation id is a
conversation of its own; null turns come first; rows of one conversation and
turn come in the order of a 128-bit hash of role and text, and equal ones are
duplicates of the first; two turns are equal when their 128-bit hashes are; a
conversation without rows has an empty audit; empty tables give an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLOCK = 4
START, SYSTEM, USER, ASSISTANT = range(4)
ROLE_AFTER = (USER, USER, ASSISTANT, USER)  # the state a user or assistant turn leads to, from each state
ROLES = {USER: "user", ASSISTANT: "assistant"}
GONE = 0         # symbol of a turn that must be deleted; others: 1 + 2 * initial + truncated
INITIALS = "uas"  # any other initial is the fourth
SYMBOLS = 9
_FAR = 1 << 20


def keep_leads(state: int, initial: int) -> int | None:
    """State after keeping a turn of this initial, if that is legal."""
    if initial == 2:
        return SYSTEM if state == START else None
    if initial == 3:
        return None
    return ROLE_AFTER[state] if ROLE_AFTER[state] == (USER, ASSISTANT)[initial] else None


def _with_inserts(costs: list[int]) -> tuple[int, ...]:
    out = list(costs)
    for _ in range(3):
        out = [min(c, INSERT + out[ROLE_AFTER[s]]) for s, c in enumerate(out)]
    return tuple(out)


END = _with_inserts([0, _FAR, _FAR, 0])


def before(costs: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """Costs of finishing from each state in front of a turn, from those behind it."""
    out = []
    for s in range(4):
        best = DELETE + costs[s]
        if symbol != GONE:
            initial, cut = divmod(symbol - 1, 2)
            best = min(best, TRUNCATED * cut + REROLE + costs[ROLE_AFTER[s]])
            to = keep_leads(s, initial)
            if to is not None:
                best = min(best, TRUNCATED * cut + costs[to])
        out.append(best)
    return _with_inserts(out)


@cache
def tables() -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Normalised vectors (the first is that of the end), and for one symbol and for a block: the vector before, the added cost."""
    vectors, known = [END], {END: 0}
    step, add = [], []
    for v in vectors:  # grows while it is read
        for symbol in range(SYMBOLS):
            now = before(v, symbol)
            low = min(now)
            now = tuple(c - low for c in now)
            if now not in known:
                known[now] = len(vectors)
                vectors.append(now)
            step.append(known[now])
            add.append(low)
    step1 = np.array(step, np.int32).reshape(-1, SYMBOLS)
    add1 = np.array(add, np.int32).reshape(-1, SYMBOLS)
    step_b, add_b = step1, add1
    for _ in range(BLOCK - 1):  # one more symbol in front, the most significant digit of a block's number
        add_b = np.concatenate([add_b + add1[step_b, x] for x in range(SYMBOLS)], axis=1)
        step_b = np.concatenate([step1[step_b, x] for x in range(SYMBOLS)], axis=1)
    return vectors, step1, add1, step_b, add_b


def audit(symbols: bytes) -> tuple[str, int]:
    """Least audit of the cheapest edits of a conversation, and their cost."""
    vectors, step1, add1, step_b, add_b = tables()
    full = len(symbols) // BLOCK
    now, total = 0, 0
    tail = [now]
    for x in reversed(symbols[full * BLOCK:]):
        total += int(add1[now, x])
        now = int(step1[now, x])
        tail.append(now)
    digits = np.frombuffer(symbols[:full * BLOCK], np.uint8).reshape(full, BLOCK).astype(np.int64)
    numbers = (digits @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))).tolist()
    right = np.zeros(full, np.int32)  # vector behind each block
    for b in range(full - 1, -1, -1):
        right[b] = now
        total += int(add_b[now, numbers[b]])
        now = int(step_b[now, numbers[b]])
    total += vectors[now][START]
    out: list[str] = []
    state = START

    def trace(block: bytes, inside: list[int]) -> None:
        """Edits through some turns; inside: the vectors in front of each of them and behind the last."""
        nonlocal state
        for k, x in enumerate(block):
            here, behind = vectors[inside[k]], vectors[inside[k + 1]]
            extra = int(add1[inside[k + 1], x])
            initial, cut = divmod(x - 1, 2)
            while True:
                goal = here[state] + extra
                if DELETE + behind[state] == goal:
                    out.append("D")
                    break
                if INSERT + here[ROLE_AFTER[state]] == here[state]:
                    out.append("I")
                    state = ROLE_AFTER[state]
                    continue
                to = keep_leads(state, initial) if x != GONE else None
                if to is not None and TRUNCATED * cut + behind[to] == goal:
                    out.append("K")
                    state = to
                    break
                out.append("R")
                state = ROLE_AFTER[state]
                break

    for b in range(full):
        block = symbols[b * BLOCK:(b + 1) * BLOCK]
        inside = [int(right[b])]
        for x in reversed(block):
            inside.append(int(step1[inside[-1], x]))
        trace(block, inside[::-1])
    trace(symbols[full * BLOCK:], tail[::-1])
    while END[state]:
        out.append("I")
        state = ROLE_AFTER[state]
    return "".join(out), total


# ---- the job -----------------------------------------------------------------

_ORDER = ["conv", "turn", "key_a", "key_b"]  # null turns first


def _conv() -> Column:
    """Ids travel as text; '' is the null id."""
    return F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv")


def _keyed(convs: DataFrame) -> DataFrame:
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = convs.select(_conv(), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    return rows.select("*", *common.content_key(F.col("role"), F.col("text")))


def _symbols(rows: DataFrame) -> DataFrame:
    """Per turn, without its text: place in the order, initial, faults (blank, cut) and whether an equal one stands at an earlier turn."""
    last = F.expr(r"right(rtrim(' \t\n\u000B\f\r', text), 1)")
    narrow = common.materialise(
        rows.select(
            *_ORDER,
            F.substring("role", 1, 1).alias("initial"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"),
        ),
        "repair-turns",
    )
    firsts = common.materialise(
        narrow.groupBy("conv", "key_a", "key_b")
        .agg(F.count("*").alias("n"), F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("none"))
        .where("n > 1").drop("n"),
        "repair-repeats",
    )
    later = F.coalesce(F.col("turn").isNotNull() & (F.col("none") | (F.col("turn") > F.col("least"))), F.lit(False))
    return narrow.join(firsts, ["conv", "key_a", "key_b"], "left").select(*_ORDER, "initial", "blank", "cut", later.alias("later"))


_AUDIT = ("conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def _audit_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Faults, cost and audit per conversation; the rows come sorted."""
    legal = {"su", "ua", "au"}
    conv, symbols, counts, turns, mark, ini = None, bytearray(), [0] * 4, [], None, None

    def row() -> tuple:
        edits, cost = audit(bytes(symbols))
        gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
        return (conv, gaps, *counts, cost, edits)

    for batch in batches:
        out = []
        # Turns as text: nulls must not make floats of them.
        for c, t, a, b, initial, blank, cut, later in zip(*(batch[x].tolist() for x in (
                "conv", "turn", "key_a", "key_b", "initial", "blank", "cut", "later"))):
            if c != conv:
                if conv is not None:
                    out.append(row())
                conv, symbols, counts, turns, mark, ini = c, bytearray(), [0] * 4, [], None, None
            if t is not None:
                if not turns:
                    turns = [int(t), int(t), 1]
                elif int(t) != turns[1]:
                    turns[1:] = [int(t), turns[2] + 1]
            if ini is not None and ini + initial not in legal:
                counts[3] += 1
            ini = initial
            again = later or mark == (t, a, b)
            mark = (t, a, b)
            if blank:
                counts[0] += 1
            elif again:
                counts[1] += 1
            elif cut:
                counts[2] += 1
            kind = INITIALS.find(initial) if initial else 3
            symbols.append(GONE if blank or again else 1 + 2 * (kind if kind >= 0 else 3) + cut)
        yield pd.DataFrame(out, columns=[x.split()[0] for x in _AUDIT.split(", ")])
    if conv is not None:
        yield pd.DataFrame([row()], columns=[x.split()[0] for x in _AUDIT.split(", ")])


def audits(rows: DataFrame) -> DataFrame:
    """One row per conversation that has rows: conv (id as text), gaps, blank, duplicate, truncated, illegal, cost, audit."""
    turns = _symbols(rows).repartition("conv").sortWithinPartitions(*_ORDER)
    return turns.withColumn("turn", F.col("turn").cast("string")).mapInPandas(_audit_rows, _AUDIT)


_REPAIRED = "conv string, place long, role string, text string, edit string"


def _repaired_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Repaired turns; every conversation's audit comes first, then its turns in order."""
    conv, edits, at, state, place = None, "", 0, START, 0
    out: list[tuple] = []

    def inserts() -> None:
        nonlocal at, state, place
        while at < len(edits) and edits[at] == "I":
            state = ROLE_AFTER[state]
            out.append((conv, place, ROLES[state], "", "I"))
            at, place = at + 1, place + 1

    for batch in batches:
        out = []
        for c, plan, role, text in zip(*(batch[x].tolist() for x in ("conv", "audit", "role", "text"))):
            if plan is not None:
                inserts()
                conv, edits, at, state, place = c, plan, 0, START, 0
                continue
            inserts()
            edit = edits[at]
            at += 1
            if edit == "D":
                continue
            if edit == "R":
                state = ROLE_AFTER[state]
                role = ROLES[state]
            else:
                state = keep_leads(state, INITIALS.index(role[0]))
            out.append((conv, place, role, text, edit))
            place += 1
        yield pd.DataFrame(out, columns=[x.split()[0] for x in _REPAIRED.split(", ")])
    out = []
    inserts()
    yield pd.DataFrame(out, columns=[x.split()[0] for x in _REPAIRED.split(", ")])


def repair(convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Audits and repaired turns of a table with conv_id, turn, role and text.

    Returns (audits: see :func:`audits`; repaired: conv (id as text), place,
    role, text and edit (K, R or I), the turns of a conversation in order in
    one partition).
    """
    rows = _keyed(convs)
    plans = common.materialise(audits(rows), "repair-audits")
    nothing = F.lit(None).cast("string")
    stream = rows.select("*", F.lit(1).alias("kind"), nothing.alias("audit")).unionByName(
        plans.select(
            "conv", F.lit(None).cast("long").alias("turn"), nothing.alias("role"), nothing.alias("text"),
            *[F.lit(None).cast("long").alias(k) for k in ("key_a", "key_b")], F.lit(0).alias("kind"), "audit",
        )
    )
    ordered = stream.repartition("conv").sortWithinPartitions("conv", "kind", *_ORDER[1:])
    return plans, ordered.select("conv", "audit", "role", "text").mapInPandas(_repaired_rows, _REPAIRED)


def _digest_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    conv, digest = None, None
    for batch in batches:
        out = []
        for c, role, text in zip(batch["conv"].tolist(), batch["role"].tolist(), batch["text"].tolist()):
            if c != conv:
                if conv is not None:
                    out.append((conv, digest.hexdigest()))
                conv, digest = c, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        yield pd.DataFrame(out, columns=["conv", "repaired_sha256"])
    if conv is not None:
        yield pd.DataFrame([(conv, digest.hexdigest())], columns=["conv", "repaired_sha256"])


def digests(repaired: DataFrame) -> DataFrame:
    """conv and SHA-256 of its repaired ``role:text`` turns, newline-joined; a conversation's turns stand in order in one partition."""
    return repaired.select("conv", "role", "text").mapInPandas(_digest_rows, "conv string, repaired_sha256 string")


def damage(convs: DataFrame) -> DataFrame:
    """The contract's damage, by crc32 of ``conv_id:turn`` modulo 20 (nulls: one blank)."""

    def shown(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = shown("text")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(F.col("kind") == 4, "user").otherwise(shown("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        convs.withColumn("kind", kind).where("kind <> 0")
        .select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))
        .drop("copy")
    )


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repair of all damaged conversations: faults, cost, audit and a hash of the repaired turns."""
    convs = common.read_table(spark, sf_dir, "conversations")
    plans, repaired = repair(damage(convs))
    ids = convs.select("conv_id").distinct().withColumn("conv", _conv())
    found = ids.join(plans, "conv", "left").join(digests(repaired), "conv", "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return found.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
