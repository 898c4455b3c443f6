"""Repair of conversation structure by iterative-deepening A*.

A conversation's roles must read ``(s?(ua)+)?``: an optional system row, then
user and assistant in turn. Edits walk its rows in order: Keep (0), Rerole to
user or assistant (2), Delete (3; the only edit of a blank or duplicate row)
and Insert of an empty user or assistant row (2); a truncated row that stays
costs 1 more. Of the cheapest edits the audit string of initials that is least
in ASCII order wins. The search is depth first in that order (D, I, K, R) under
a cost bound that rises by one; a table of failed (row, role) states holds the
largest budget each has failed with, so the first path that is accepted is the
answer.

Given where it starts, an audit string fixes every role, so it also fixes the
repaired rows; and two audits of the same rows are never each other's prefix if
inserts go before a row. That makes the search exact on pieces: a conversation
is searched ``PIECE`` rows at a time from every role the piece before may have
ended with, to every role this one may end with, and per role only the best
path is kept. So a conversation of any length streams through its task in
bounded memory (but for its audit, one character an edit, which is the result).
The digest of the repaired conversation reads its rows in order, so one task
reads a whole conversation; it never holds more than a piece of it.

Nulls and ties: a null role or text is one space; null turns come first; a null
``conv_id`` is a conversation of its own. Rows of one turn are ordered by role
and text, so repeated rows are adjacent and the later ones duplicates. Dropped
rows don't count, but their conversation is returned. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PIECE = 64
SPACES = " \t\n\x0b\x0c\r"
DELETE, INSERT, KEEP, REROLE = 3, 2, 0, 2
START, S, U, A = range(4)                # what the repaired rows end with so far
OTHER = 0                                # a role that is neither system, user nor assistant
NEXT = {START: U, S: U, U: A, A: U}      # the role an insert or a rerole gives
KEPT = {(START, S): S, (START, U): U, (S, U): U, (A, U): U, (U, A): A}
LEGAL = {(S, U), (U, A), (A, U)}
NAMES = {U: "user", A: "assistant"}
FINE, TRUNCATED, GONE = range(3)         # gone: blank or duplicate


def role_of(code: int) -> int:
    return code // 3


def bounds(codes: bytes, last: bool) -> list[list[int]]:
    """Least cost of the rows from i on, for each role before them: required deletes, truncated rows, and a
    rerole, delete or insert for every two pairs of neighbours that can't stay."""
    out: list[list[int]] = [[0] * 4 for _ in range(len(codes) + 1)]
    if last:
        out[-1] = [0, 2, 2, 0]
    sure, pairs, first = 0, 0, None      # of rows i, i+1, ...: certain cost, illegal pairs after the first row that may stay
    for i in range(len(codes) - 1, -1, -1):
        role, fault = divmod(codes[i], 3)
        if fault == GONE:
            sure += DELETE
        else:
            sure += fault == TRUNCATED
            if first is None:
                pairs += last and role != A
            else:
                pairs += (role, first) not in LEGAL
            first = role
        for before in range(4):
            if first is None:
                bad = last and before in (S, U)
            else:
                bad = pairs + ((before, first) not in KEPT)
            out[i][before] = sure + 2 * ((bad + 1) // 2)
    return out


def cheapest(codes: bytes, start: int, end: int | None, limit: int | None = None) -> tuple[int, str] | None:
    """(cost, audit) of the least path from role ``start`` through all rows to role ``end`` (None: to an accepted
    end, with inserts after the last row), or None where there is none of at most ``limit``."""
    n, last = len(codes), end is None
    if limit is None:
        limit = 3 * n + 8
    least, failed, path = bounds(codes, last), {}, []

    def dig(i: int, role: int, budget: int) -> bool:
        if i == n and (role in (START, A) if last else role == end):
            return True
        if i == n and not last or least[i][role] > budget or failed.get((i, role), -1) >= budget:
            return False
        here = codes[i] if i < n else None
        for letter, cost, j, to in moves(here, i, role):
            if cost <= budget:
                path.append(letter)
                if dig(j, to, budget - cost):
                    return True
                path.pop()
        failed[i, role] = budget
        return False

    def moves(here, i, role):
        if here is not None:
            yield "D", DELETE, i + 1, role
        yield "I", INSERT, i, NEXT[role]
        if here is not None and here % 3 != GONE:
            cut = here % 3 == TRUNCATED
            to = KEPT.get((role, here // 3))
            if to is not None:
                yield "K", KEEP + cut, i + 1, to
            yield "R", REROLE + cut, i + 1, NEXT[role]
    for bound in range(least[0][start], limit + 1):
        if dig(0, start, bound):
            return bound, "".join(path)
    return None


@lru_cache(maxsize=1 << 14)
def exits(codes: bytes, start: int, last: bool) -> dict[int, tuple[int, str]]:
    """The least path to each end of a piece that can still be part of the answer.

    After A a conversation goes on at most 3 dearer than from the start, never dearer than after S, and 2 dearer
    than after U (the reverse too), so dearer ends are left out.
    """
    if last:
        return {A: cheapest(codes, start, None)}
    out = {}
    if found := cheapest(codes, start, A):
        out[A] = found
    roof = found[0] if found else None
    for end, more in ((U, 2), (START, 3), (S, 0)):
        if end == START and start != START or end == S and start not in (START, S):
            continue
        if found := cheapest(codes, start, end, None if roof is None else roof + more):
            out[end] = found
    return out


class Repair:
    """One conversation, fed row by row in order."""

    def __init__(self, conv_id):
        self.conv_id, self.rows, self.codes = conv_id, [], bytearray()
        self.first = self.last = self.turns = None
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.before = None
        # by role: cost, order among the paths kept, audit, digest, whether it holds a row
        self.paths = {START: (0, 0, [], hashlib.sha256(), False)}

    def add(self, turn, role: str, text: str, fault: str | None) -> None:
        if len(self.codes) == PIECE:
            self.search(last=False)
        if turn is not None:
            if self.turns is None:
                self.first, self.turns = turn, 1
            elif turn != self.last:
                self.turns += 1
            self.last = turn
        if fault is not None:
            self.counts[fault] += 1
        if self.before is not None:
            self.counts["illegal"] += self.before + role[:1] not in ("su", "ua", "au")
        self.before = role[:1]
        kind = " sua".find(role[:1] or " ")
        self.codes.append(3 * max(kind, OTHER) + (FINE if fault is None else TRUNCATED if fault == "truncated" else GONE))
        self.rows.append((role, text))

    def search(self, last: bool) -> None:
        codes = bytes(self.codes)
        found: dict[int, list] = {}
        for role, (cost, order, *_) in self.paths.items():
            for end, (more, audit) in exits(codes, role, last).items():
                found.setdefault(end, []).append((cost + more, order, audit, role))
        best = {end: min(each) for end, each in found.items()}
        if A in best:
            most = best[A][0]
            best = {end: x for end, x in best.items() if x[0] <= most + {START: 3, S: 0, U: 2, A: 0}[end]}
        order = {x[1:3]: i for i, x in enumerate(sorted(best.values(), key=lambda x: x[1:3]))}
        paths = {}
        for end, (cost, rank, audit, role) in best.items():
            _, _, so_far, digest, filled = self.paths[role]
            digest = digest.copy()
            for _, name, text in apply(audit, role, self.rows):
                digest.update((b"\n" if filled else b"") + f"{name}:{text}".encode())
                filled = True
            paths[end] = (cost, order[rank, audit], [*so_far, audit], digest, filled)
        self.paths, self.rows, self.codes = paths, [], bytearray()

    def result(self) -> tuple:
        self.search(last=True)
        cost, _, audit, digest, _ = min(self.paths.values(), key=lambda x: x[:2])
        gaps = 0 if self.turns is None else self.last - self.first + 1 - self.turns
        return (self.conv_id, gaps, *self.counts.values(), cost, "".join(audit), digest.hexdigest())


def apply(audit: str, role: int, rows: list[tuple[str, str]]):
    """(edit, role, text) of the rows that an audit leaves, from the role before them."""
    i = 0
    for letter in audit:
        if letter == "I":
            role = NEXT[role]
            yield letter, NAMES[role], ""
            continue
        name, text = rows[i]
        i += 1
        if letter == "K":
            role = " sua".index(name[0])
            yield letter, name, text
        elif letter == "R":
            role = NEXT[role]
            yield letter, NAMES[role], text


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped): rows damaged by crc32 of ``conv_id:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 takes its full stops, exclamation and question marks, 3 repeats it, 4 gives it to the user.
    """
    space = F.lit(" ")
    filled = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                         F.coalesce(F.col("role").cast("string"), space).alias("role"),
                         F.coalesce(F.col("text").cast("string"), space).alias("text"))
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    hit = filled.withColumn("hit", F.pmod(F.crc32(key.cast("binary")), F.lit(20)))
    text = F.when(F.col("hit").isin(0, 1), "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return (hit.select("conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       (F.col("hit") == 0).alias("dropped"), F.explode(F.sequence(F.lit(1), F.when(F.col("hit") == 3, 2).otherwise(1))).alias("copy"))
            .drop("copy"))


def in_order(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped, fault) with whole conversations in a partition, in order.

    One shuffle: the rows of equal role and text of a conversation meet where the conversation does.
    """
    # a null and a number of one turn differ; dropped rows come last and are no one's first
    dealt = rows.repartition("conv_id")
    same = Window.partitionBy("conv_id", "role", "text", "dropped").orderBy(F.col("turn").asc_nulls_first())
    end = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)
    fault = F.when(end == "", "blank").when(F.col("nth") > 1, "duplicate").when(~end.isin(".", "!", "?"), "truncated")
    return (dealt.withColumn("nth", F.row_number().over(same))
            .sortWithinPartitions("conv_id", "dropped", F.col("turn").asc_nulls_first(), "role", "text", "nth")
            .select("conv_id", "turn", "role", "text", "dropped", fault.alias("fault")))


RESULT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string")


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text, dropped): counts of its faults, cost and audit
    of its repair and the SHA-256 of the repaired ``role:text`` lines."""
    schema = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                        ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def task(batches):
        now, out = None, []

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out.clear()
            return batch
        for batch in batches:
            for conv_id, turn, role, text, dropped, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        out.append(now.result())
                    now = Repair(conv_id)
                if not dropped:
                    now.add(turn, role, text, fault)
            if len(out) >= 1024:
                yield flush()
        if now is not None:
            out.append(now.result())
        if out:
            yield flush()
    return in_order(rows).mapInArrow(task, RESULT)


def repaired_rows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, position, edit, role, text): the conversations that the audits in ``found`` (from :func:`repair`) leave.

    An audit travels once, ahead of its conversation's rows.
    """
    kept = rows.filter("not dropped").select("conv_id", F.lit(1).alias("part"), "turn", "role", "text")
    audits = found.select("conv_id", F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
                          F.col("audit").alias("text"))
    dealt = kept.unionByName(audits).repartition("conv_id").sortWithinPartitions(
        "conv_id", "part", F.col("turn").asc_nulls_first(), "role", "text")

    def task(batches):
        audit, at, role, position, conv = "", 0, START, 0, None
        for batch in batches:
            out = []

            def inserts():
                nonlocal at, role, position
                while at < len(audit) and audit[at] == "I":
                    role = NEXT[role]
                    out.append((conv, position, "I", NAMES[role], ""))
                    at, position = at + 1, position + 1
            for conv_id, part, _, name, text in zip(*(c.to_pylist() for c in batch.columns)):
                if part == 0:
                    inserts()
                    conv, audit, at, role, position = conv_id, text, 0, START, 0
                    inserts()
                    continue
                letter = audit[at]
                for edit, name, text in apply(letter, role, [(name, text)]):
                    role = NEXT[role] if edit == "R" else " sua".index(name[0])
                    out.append((conv, position, edit, name, text))
                    position += 1
                at += 1
                inserts()
            if out:
                conv_ids, positions, edits, names, texts = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(conv_ids, pa.int64()), pa.array(positions, pa.int64()), pa.array(edits, pa.string()),
                                                  pa.array(names, pa.string()), pa.array(texts, pa.string())],
                                                 names=["conv_id", "position", "edit", "role", "text"])
    return dealt.mapInArrow(task, "conv_id long, position long, edit string, role string, text string")
