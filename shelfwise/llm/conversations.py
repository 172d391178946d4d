"""Repair of the structure of conversations, with an audit of the cheapest edits.

The rows of a conversation, by turn, are to read as roles `(s?(ua)+)?`: nothing, or a system row at most and then user and
assistant in turn. Keeping a row costs nothing, giving it the role user or assistant 3, deleting it 4 (blank rows and repeats
must go), an empty user or assistant row put in anywhere 3; a truncated row that stays costs 3 more. The audit is the string of
edits (K, R, D, I); of the cheapest audits the ASCII-least is taken.

How it runs on Spark: rows are put in order by ranges of (conversation, turn, role, text digest), so that a conversation of
any size spreads over tasks. Each task cuts its rows into blocks of one conversation and works out, for every pair of states
before and after a block, the cheapest least audit. Then the blocks of a conversation are chained, the rows with their texts
follow their audit in order, and both steps read a sorted stream: a task holds one batch and one audit, never a conversation.

Within a block audits are prefixes that share nodes (parent, edit), each with its depth, a rolling hash and its ancestors at
powers of two. Two prefixes of equal cost are compared at the edit after their longest common prefix, found by descending the
ancestors. Nodes are interned by hash and verified by parent and edit: the same prefix is the same node, so a collision of
hashes cannot make different audits equal.

Two prefixes over the same rows where one continues the other differ by inserted rows only, hence in cost: among equal costs
neither is a prefix of the other, and the least prefix stays least whatever follows. That is why blocks can be chained.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shelfwise.llm.common import stored

RETAG, DROP, ADD, CUT = 3, 4, 3, 3
#: Rows of one block: what a task holds of a conversation at once.
BLOCK = 2_048
#: States are the last role put out: nothing yet, system, user, assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
_ROLE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_AFTER = {(NOTHING, SYSTEM), (NOTHING, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
_NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_LEGAL = {"su", "ua", "au"}
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
_BASE, _MOD = 1_000_003, (1 << 61) - 1


class Prefixes:
    """Edit strings as linked nodes; node 0 is the empty string."""

    def __init__(self) -> None:
        self.edit, self.depth, self.hash, self.up = [""], [0], [0], [(0,)]
        self.known: dict[int, list[int]] = {}

    def add(self, node: int, edit: str) -> int:
        """The node of node's string and one more edit."""
        value = (self.hash[node] * _BASE + ord(edit)) % _MOD
        bucket = self.known.setdefault(value, [])
        for other in bucket:
            if self.up[other][0] == node and self.edit[other] == edit:
                return other
        fresh, above, k = len(self.edit), [node], 0
        while above[-1] and k < len(self.up[above[-1]]):
            above.append(self.up[above[-1]][k])
            k += 1
        self.edit.append(edit), self.depth.append(self.depth[node] + 1), self.hash.append(value), self.up.append(tuple(above))
        bucket.append(fresh)
        return fresh

    def lifted(self, node: int, depth: int) -> int:
        """The ancestor of a depth."""
        while self.depth[node] > depth:
            gap = self.depth[node] - depth
            node = self.up[node][min(gap.bit_length(), len(self.up[node])) - 1]
        return node

    def less(self, a: int, b: int) -> bool:
        """Whether a's string comes before b's; of a string and its continuation the string."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.lifted(a, depth), self.lifted(b, depth)
        if x == y:
            return self.depth[a] < self.depth[b]
        while self.up[x][0] != self.up[y][0]:
            for k in reversed(range(min(len(self.up[x]), len(self.up[y])))):
                if self.up[x][k] != self.up[y][k]:
                    x, y = self.up[x][k], self.up[y][k]
                    break
        return self.edit[x] < self.edit[y]

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.edit[node])
            node = self.up[node][0]
        return "".join(reversed(out))


Best = dict[int, tuple[int, int]]  # state: cost, node


def _offer(best: Best, prefixes: Prefixes, state: int, cost: int, node: int) -> bool:
    held = best.get(state)
    if held and (cost > held[0] or (cost == held[0] and not prefixes.less(node, held[1]))):
        return False
    best[state] = cost, node
    return True


def _inserted(best: Best, prefixes: Prefixes) -> Best:
    """With rows put in before the next row. Two of them suffice: a third only comes back to where it was."""
    for _ in range(2):
        for state, (cost, node) in list(best.items()):
            reached = _NEXT[state]
            if reached not in best or cost + ADD <= best[reached][0]:
                _offer(best, prefixes, reached, cost + ADD, prefixes.add(node, "I"))
    return best


def block_audits(rows: list[tuple[str, int]]) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, audit) of a block of rows (role initial, fault): the cheapest, then least, audits.

    Rows put in after the last row belong to the next block, or to the end.
    """
    out = []
    for before in range(4):
        prefixes, best = Prefixes(), {before: (0, 0)}
        for initial, fault in rows:
            found: Best = {}
            for state, (cost, node) in _inserted(best, prefixes).items():
                _offer(found, prefixes, state, cost + DROP, prefixes.add(node, "D"))
                if fault in (BLANK, DUPLICATE):
                    continue
                cost += CUT if fault == TRUNCATED else 0
                role = _ROLE.get(initial)
                if (state, role) in _AFTER:
                    _offer(found, prefixes, role, cost, prefixes.add(node, "K"))
                _offer(found, prefixes, _NEXT[state], cost + RETAG, prefixes.add(node, "R"))
            best = found
        out += [(before, after, cost, prefixes.text(node)) for after, (cost, node) in sorted(best.items())]
    return out


class Chain:
    """The cheapest least audits of a growing list of blocks, for every state reached.

    Only four strings are alive. Of any two it is known which comes first, or that one continues the other and by how
    much; so the strings of a further block are compared by their new pieces alone.
    """

    def __init__(self) -> None:
        self.best: dict[int, tuple[int, tuple | None]] = {NOTHING: (0, None)}
        self.order: dict[tuple[int, int], tuple[int, str]] = {(NOTHING, NOTHING): (0, "")}

    def _compare(self, i: int, s: str, j: int, t: str) -> tuple[int, str]:
        """How string i and then s stands to string j and then t: (-1 or 1, ''), or (0, what the second has beyond the first),
        with a leading '-' for what it lacks."""
        sign, rest = self.order[i, j]
        if sign:
            return sign, ""
        s, t = (rest[1:] + s, t) if rest.startswith("-") else (s, rest + t)
        shared = min(len(s), len(t))
        if s[:shared] != t[:shared]:
            return (-1, "") if s < t else (1, "")
        return 0, t[shared:] if len(t) >= len(s) else "-" + s[shared:]

    def add(self, moves: list[tuple[int, int, int, str]]) -> None:
        taken: dict[int, tuple[int, int, str]] = {}
        for before, after, cost, piece in moves:
            if before not in self.best:
                continue
            total, held = self.best[before][0] + cost, taken.get(after)
            if held and total == held[0]:
                sign, rest = self._compare(before, piece, held[1], held[2])
                better = sign < 0 or (sign == 0 and bool(rest) and not rest.startswith("-"))
            else:
                better = not held or total < held[0]
            if better:
                taken[after] = total, before, piece
        pairs = {(x, y): self._compare(taken[x][1], taken[x][2], taken[y][1], taken[y][2]) for x in taken for y in taken}
        self.best = {after: (total, (self.best[before][1], piece)) for after, (total, before, piece) in taken.items()}
        self.order = pairs

    def finish(self) -> tuple[int, str]:
        """Cost and audit of the whole."""
        end = Chain()
        end.best, end.order = self.best, self.order
        # Both ends, nothing and an assistant, count as one state: the cheaper, then lesser, is taken.
        end.add([(before, ASSISTANT, n * ADD, "I" * n) for before, n in ((NOTHING, 0), (SYSTEM, 2), (USER, 1), (ASSISTANT, 0))])
        cost, piece = end.best[ASSISTANT]
        parts = []
        while piece is not None:
            piece, part = piece
            parts.append(part)
        return cost, "".join(reversed(parts))


def _shown(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def _strict(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and the digest of the text, nulls of role and text as one space."""
    typed = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _shown("role").alias("role"), _shown("text").alias("text"))
    return typed.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))


_SPACE = " \t\n\x0b\x0c\r"
#: Nulls come first.
_ORDER = ["conv_id", "turn", "role", "digest"]
_BLOCKS = (
    "conv_id long, task int, block long, first_turn long, last_turn long, turns long, first string, last string, "
    "blank long, duplicate long, truncated long, illegal long, moves array<struct<before:int,after:int,cost:bigint,audit:string>>"
)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id, turn, role, digest, fault, task) to blocks."""
    rows, key, previous, out = [], None, None, []

    def block() -> dict:
        turns = [r[0] for r in rows if r[0] is not None]
        faults = [r[2] for r in rows]
        return {
            "conv_id": key[0], "task": key[1], "block": key[2], "first_turn": turns[0] if turns else None,
            "last_turn": turns[-1] if turns else None, "turns": len(set(turns)), "first": rows[0][1], "last": rows[-1][1],
            "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED),
            "illegal": sum(a[1] + b[1] not in _LEGAL for a, b in zip(rows, rows[1:])),
            "moves": [dict(zip(("before", "after", "cost", "audit"), m)) for m in block_audits([r[1:] for r in rows])],
        }

    for batch in batches:
        for conv, turn, role, digest, fault, task in zip(*(c.to_pylist() for c in batch.columns)):
            if key is None or key[:2] != (conv, task):
                if rows:
                    out.append(block())
                rows, key, previous = [], (conv, task, 0), None
            elif len(rows) == size:
                out.append(block())
                rows, key = [], (conv, task, key[2] + 1)
            same = (turn, role, digest)
            if fault in (FINE, TRUNCATED) and same == previous:
                fault = DUPLICATE
            previous = same
            rows.append((turn, role[:1], fault))
        if len(out) >= 256:
            yield from _batches(out)
            out = []
    if rows:
        out.append(block())
    yield from _batches(out)


_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
_MOVE = pa.list_(pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def _batches(rows: list[dict], schema: str = _BLOCKS) -> Iterator[pa.RecordBatch]:
    fields = [f.split() for f in schema.split(", ")]
    kinds = pa.schema([(name, _KINDS.get(kind, _MOVE)) for name, kind in fields])
    if rows:
        yield from pa.Table.from_pylist(rows, kinds).to_batches()


_REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of each conversation, in order, to its report."""
    key, chain, seen = None, None, None

    def report() -> dict:
        cost, audit = chain.finish()
        span = seen["high"] - seen["low"] + 1 - seen["turns"] if seen["turns"] else 0
        return {"conv_id": key[0], "gaps": span, **{k: seen[k] for k in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost, "audit": audit}

    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if key != (row["conv_id"],):
                if key:
                    out.append(report())
                key, chain = (row["conv_id"],), Chain()
                seen = dict.fromkeys(("turns", "blank", "duplicate", "truncated", "illegal"), 0) | {"last": None, "low": None, "high": None}
            for k in ("blank", "duplicate", "truncated", "illegal", "turns"):
                seen[k] += row[k]
            if seen["last"] is not None:
                seen["illegal"] += seen["last"] + row["first"] not in _LEGAL
            if row["turns"]:
                seen["turns"] -= row["first_turn"] == seen["high"]
                seen["low"] = row["first_turn"] if seen["low"] is None else seen["low"]
                seen["high"] = row["last_turn"]
            seen["last"] = row["last"]
            chain.add([(m["before"], m["after"], m["cost"], m["audit"]) for m in row["moves"]])
        yield from _batches(out, _REPORT)
    if key:
        yield from _batches([report()], _REPORT)


def diagnose(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each conversation of rows (conv_id, turn, role, text): gaps, blank, duplicate, truncated, illegal, cost, audit.

    Rows count by turn (nulls first), then role and text digest. A null role or text is one space; a null conv_id is a
    conversation of its own. blank: no character but ASCII white space; duplicate: role and text stood earlier (texts are
    told apart by SHA-256); truncated: the last such character is none of . ! ? - the first that holds counts. gaps: turns missing between the least
    and the greatest, 0 if all are null. illegal: neighbours whose role initials are none of su, ua, au. Repeated rows are
    duplicates; other columns are not read. A conversation without rows has no report; an empty table gives none.
    """
    end = F.rtrim(F.col("text"), F.lit(_SPACE))
    fault = F.when(end == "", BLANK).when(~F.right(end, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
    slim = stored(_strict(rows).select("conv_id", "turn", "role", "digest", fault.alias("fault")), "conversation_rows")
    # Texts that occur again in their conversation: the least turn is the first. A null turn is the least of all.
    first = slim.groupBy("conv_id", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("has"), "turn")).alias("least"), F.count("*").alias("n"))
    again = first.where("n > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "least")
    later = slim.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    is_later = F.col("least").isNotNull() & ~F.col("turn").eqNullSafe(F.col("least.turn"))
    marked = stored(later.select("conv_id", "turn", "role", "digest", F.when((F.col("fault") != BLANK) & is_later, DUPLICATE).otherwise(F.col("fault")).alias("fault")), "conversation_faults")
    placed = marked.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
    blocks = placed.withColumn("task", F.spark_partition_id()).mapInArrow(lambda batches: _blocks(batches, block), _BLOCKS)
    return blocks.repartition("conv_id").sortWithinPartitions("conv_id", "task", "block").mapInArrow(_reports, _REPORT)


_REPAIRED = "conv_id long, place long, role string, text string, edit string"


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, is_row, turn, role, digest, text, audit), each conversation's audit before its rows, to repaired rows."""
    audit, at, place, state, conv = "", 0, 0, NOTHING, None

    def put(role: str, text: str, edit: str) -> dict:
        return {"conv_id": conv, "place": place, "role": role, "text": text, "edit": edit}

    names = {USER: "user", ASSISTANT: "assistant"}
    for batch in batches:
        out = []
        columns = (batch.column(i) for i in (0, 1, 3, 5, 6))
        for conv_id, is_row, role, text, found in zip(*(c.to_pylist() for c in columns)):
            if not is_row:
                conv, audit, at, place, state = conv_id, found, 0, 0, NOTHING
            else:
                edit, at = audit[at], at + 1
                if edit != "D":
                    state = _ROLE[role[:1]] if edit == "K" else _NEXT[state]
                    out.append(put(role if edit == "K" else names[state], text, edit))
                    place += 1
            # Rows put in stand before the row that follows them; those after the last row end the conversation.
            while at < len(audit) and audit[at] == "I":
                state, at = _NEXT[state], at + 1
                out.append(put(names[state], "", "I"))
                place += 1
        yield from _batches(out, _REPAIRED)


def repaired(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """The repaired rows: conv_id, place (from 0), role, text and the edit K, R or I that put it there.

    A conversation's rows come one after another, in order, in one partition. reports: diagnose(rows), which must be stored.
    """
    texts = _strict(rows).select("conv_id", F.lit(True).alias("is_row"), "turn", "role", "digest", "text", F.lit(None).cast("string").alias("audit"))
    empty = [F.lit(None).cast(k).alias(c) for c, k in (("turn", "long"), ("role", "string"), ("digest", "string"), ("text", "string"))]
    both = texts.unionByName(reports.select("conv_id", F.lit(False).alias("is_row"), *empty, "audit"))
    lined = both.repartition("conv_id").sortWithinPartitions("conv_id", "is_row", *_ORDER[1:])
    return lined.mapInArrow(_follow, _REPAIRED)


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, digest = None, None

    def done() -> dict:
        return {"conv_id": key[0], "repaired_sha256": digest.hexdigest()}

    for batch in batches:
        out = []
        for conv_id, place, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 3))):
            if place == 0:
                if key:
                    out.append(done())
                key, digest = (conv_id,), hashlib.sha256()
            digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
        yield from _batches(out, _DIGESTS)
    if key:
        yield from _batches([done()], _DIGESTS)


_DIGESTS = "conv_id long, repaired_sha256 string"


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reports, repaired rows) of rows; the reports are stored."""
    reports = stored(diagnose(rows), "conversation_reports")
    return reports, repaired(rows, reports)


def damaged(rows: DataFrame) -> DataFrame:
    """rows with faults put in by crc32 of `conv_id:turn` (null: one space) modulo 20: 0 drops the row, 1 empties its text, 2 takes out
    its . ! ?, 3 repeats it, 4 sets the role user."""
    kind = F.crc32(F.concat(_shown("conv_id"), F.lit(":"), _shown("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    typed = rows.select("conv_id", "turn", _shown("role").alias("role"), _shown("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    faulty = typed.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.expr("if(kind = 3, 2, 1)").alias("times"))
    return faulty.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), "times"))).drop("col")


def digests(rows: DataFrame) -> DataFrame:
    """A report with repaired_sha256 for every conv_id of rows, from the rows after damaged(); zeros, an empty audit and the
    hash of the empty text where no row is left."""
    reports, kept = repair(damaged(rows))
    hashes = kept.mapInArrow(_hash, _DIGESTS).select(F.col("conv_id").alias("hashed"), "repaired_sha256")
    every = rows.select(F.col("conv_id").cast("long").alias("every")).distinct()
    found = every.join(reports, F.col("every").eqNullSafe(F.col("conv_id")), "left").join(hashes, F.col("every").eqNullSafe(F.col("hashed")), "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select(
        F.col("every").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
