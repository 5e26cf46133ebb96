"""Repair of the structure of conversations by the cheapest edits.

Rows of a conversation, in order, are kept (K, free), given the other role (R), deleted (D) or preceded by inserted ones
(I), so that the initials of their roles read `(s?(ua)+)?`; of equally cheap audits (the edits' initials) the least wins.

Costs and audits are found row by row for each state of that pattern. Audits share their prefixes: each is a node
that links to the one before, with its ancestors at powers of two and a rolling hash of all edits up to it, so ties are
decided by searching for the longest common prefix; where hashes say equal, the characters are compared.

A conversation may be of any length. Rows alike are counted first, all rows are sorted by ranges and cut into chunks of at
most `CHUNK` rows. A chunk is solved from each state that it may be entered in; its costs, and the order of the audits that
leave it, are all that choosing a path over many chunks needs. Chunks are joined in a tree, no task holding more than
a partition's chunks or `FAN` branches, and the chosen path goes down the tree again to the chunks, which then write their rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.common import discard, materialize, table

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows, and characters of them, of a chunk; deleted rows in a run that is a chunk of its own; branches of the tree, as bits.
CHUNK, CHARS, RUN, FAN = 1024, 8 << 20, 64, 8

#: States: nothing yet, a system row, a user row, an assistant row. What may follow, by the initial of its role.
FOLLOWS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The state after a user or assistant row that is put in.
NEXT = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
#: Rows to insert at the end, by state; nothing at all is well formed as well.
CLOSING = (0, 2, 1, 0)
LEGAL = {"su", "ua", "au"}


def _steps(initial: str, more: int) -> list[list[tuple[int, int, str]]]:
    """By state, the (state after, cost, edits) of one row. Inserts before a deletion are never best: after it they are less."""
    out = []
    for state in range(4):
        found = [(state, DELETE, "D")]
        at = state
        for n in range(3):
            if (at, initial) in FOLLOWS:
                found.append((FOLLOWS[at, initial], INSERT * n + more, "I" * n + "K"))
            found.append((NEXT[at], INSERT * n + more + REROLE, "I" * n + "R"))
            at = NEXT[at]
        out.append(found)
    return out


STEPS = {(i, cut): _steps(i, TRUNCATED if cut else 0) for i in ("s", "u", "a", "") for cut in (False, True)}


class Trail:
    """Audits as linked nodes that share their prefixes; a node stands for all edits up to it."""

    BASE, MODULUS = 1_000_003, (1 << 61) - 1

    def __init__(self):
        self.up, self.depth, self.hash, self.char = [[]], [0], [0], [""]

    def grow(self, node: int, edits: str) -> int:
        for c in edits:
            up = [node]
            while len(self.up[up[-1]]) >= len(up):
                up.append(self.up[up[-1]][len(up) - 1])
            self.up.append(up)
            self.depth.append(self.depth[node] + 1)
            self.hash.append((self.hash[node] * self.BASE + ord(c)) % self.MODULUS)
            self.char.append(c)
            node = len(self.depth) - 1
        return node

    def rise(self, node: int, by: int) -> int:
        while by:
            bit = by.bit_length() - 1
            node = self.up[node][bit]
            by -= 1 << bit
        return node

    def same(self, a: int, b: int) -> bool:
        """Whether two nodes of one depth stand for equal edits, by comparing them back to where they are shared."""
        while a != b:
            if self.char[a] != self.char[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def text(self, node: int) -> str:
        out = []
        while self.up[node]:
            out.append(self.char[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def before(self, a: int, b: int) -> bool:
        """Whether the edits of a are less than those of b: the longest common prefix decides."""
        least = min(self.depth[a], self.depth[b])
        x, y = self.rise(a, self.depth[a] - least), self.rise(b, self.depth[b] - least)
        if self.hash[x] == self.hash[y]:
            if self.same(x, y):
                return self.depth[a] < self.depth[b]
        else:
            for j in range(len(self.up[x]) - 1, -1, -1):
                if j < len(self.up[x]) and self.hash[self.up[x][j]] != self.hash[self.up[y][j]]:
                    x, y = self.up[x][j], self.up[y][j]
            if self.same(self.up[x][0], self.up[y][0]):
                return self.char[x] < self.char[y]
        return self.text(a) < self.text(b)  # two hashes met by chance


def solve(rows: list[tuple[str, bool, int]], entry: int, trail: Trail) -> dict[int, tuple[int, int]]:
    """By state after the rows, (cost, node) of the cheapest, then least audit from the state `entry`.

    rows: (initial, truncated, 0), or (.., .., n) for n rows that must go. Inserts at the end are left to what follows.
    """
    trail.up.append([])
    for kept, value in ((trail.depth, 0), (trail.hash, 0), (trail.char, "")):
        kept.append(value)
    best = {entry: (0, len(trail.depth) - 1)}
    for initial, cut, gone in rows:
        if gone:
            best = {q: (cost + DELETE * gone, trail.grow(node, "D" * gone)) for q, (cost, node) in best.items()}
            continue
        steps = STEPS[initial if initial in ("s", "u", "a") else "", cut]
        new: dict[int, tuple[int, int, str]] = {}
        for p, (cost, node) in best.items():
            for q, more, edits in steps[p]:
                old = new.get(q)
                if old is None or cost + more < old[0]:
                    new[q] = (cost + more, node, edits)
                elif cost + more == old[0]:
                    a, b = trail.grow(node, edits), trail.grow(*old[1:])
                    new[q] = (old[0], a if trail.before(a, b) else b, "")
        best = {q: (cost, trail.grow(node, edits)) for q, (cost, node, edits) in new.items()}
    return best


def ranked(best: dict[int, tuple[int, int]], trail: Trail) -> dict[int, int]:
    """The place of each state's audit among all. None is the beginning of another, as all end with the last row."""
    out: list[int] = []
    for q, (_, node) in best.items():
        at = next((i for i, o in enumerate(out) if trail.before(node, best[o][1])), len(out))
        out.insert(at, q)
    return {q: i for i, q in enumerate(out)}


def closed(best: dict[int, tuple[int, int]]) -> int:
    """The state to end in, of (cost, rank) by state: the cheapest with its closing inserts, then the least audit."""
    return min(best, key=lambda q: (best[q][0] + INSERT * CLOSING[q], best[q][1]))


class Facts:
    """Counts of the rows of a conversation as they come, or of a part of it."""

    NAMES = ("blank", "duplicate", "truncated", "illegal", "first", "last", "lo", "hi", "turns")

    def __init__(self, *values):
        self.blank, self.duplicate, self.truncated, self.illegal, self.first, self.last, self.lo, self.hi, self.turns = values or (0, 0, 0, 0, None, None, None, None, 0)

    def values(self) -> tuple:
        return tuple(getattr(self, n) for n in self.NAMES)

    def add(self, other: Facts) -> None:
        for n in ("blank", "duplicate", "truncated", "illegal", "turns"):
            setattr(self, n, getattr(self, n) + getattr(other, n))
        if self.last is not None and other.first is not None and self.last + other.first not in LEGAL:
            self.illegal += 1
        if self.hi is not None and self.hi == other.lo:
            self.turns -= 1
        self.first = other.first if self.first is None else self.first
        self.last = other.last if other.last is not None else self.last
        self.lo = other.lo if self.lo is None else self.lo
        self.hi = other.hi if other.hi is not None else self.hi

    @property
    def gaps(self) -> int:
        return 0 if self.lo is None else self.hi - self.lo + 1 - self.turns


class Chunk:
    """Consecutive rows of a conversation: texts of those that may stay, and counts of all."""

    def __init__(self):
        self.roles, self.texts, self.cut, self.gone, self.run, self.chars, self.facts = [], [], [], [], 0, 0, Facts()

    def add(self, turn: int | None, role: str, text: str | None, cut: bool, gone: int, fault: str | None) -> None:
        """A row that may stay (gone = 0), or so many alike that must go; fault names what is counted."""
        n = gone or 1
        one = Facts(0, 0, 0, n - 1, role[:1], role[:1], turn, turn, 0 if turn is None else 1)
        if fault:
            setattr(one, fault, n)
        self.facts.add(one)
        if gone > RUN:
            self.run = gone
            return
        self.roles.append(role)
        self.texts.append(text)
        self.cut.append(cut)
        self.gone.append(gone)
        self.chars += len(role) + len(text or "")

    def rows(self) -> list[tuple[str, bool, int]]:
        return [(r[:1], c, g) for r, c, g in zip(self.roles, self.cut, self.gone, strict=True)]


def written(edits: str, entry: int, roles: list[str], texts: list[str], gone: list[int]) -> list[str]:
    """`role:text` of the rows that edits leave."""
    out, at, state, i, skip = [], 0, entry, 0, 0
    while i < len(edits):
        e = edits[i]
        i += 1
        if e == "I":
            state = NEXT[state]
            out.append(f"{ROLE[state]}:")
            continue
        if e == "D":
            skip = max(gone[at], 1) - 1
            i += skip
        elif e == "K":
            state = FOLLOWS[state, roles[at][:1]]
            out.append(f"{roles[at]}:{texts[at]}")
        else:
            state = NEXT[state]
            out.append(f"{ROLE[state]}:{texts[at]}")
        at += 1
    return out


class Report:
    """One conversation's result, from its chunks in order."""

    def __init__(self):
        self.facts, self.cost, self.audit, self.sha, self.any, self.state = Facts(), 0, [], hashlib.sha256(), False, 0

    def add(self, facts: Facts, cost: int, edits: str, body: str | None, state: int) -> None:
        self.facts.add(facts)
        self.cost += cost
        self.audit.append(edits)
        if body is not None:
            self.sha.update(("\n" * self.any + body).encode("utf-8", "surrogatepass"))
            self.any = True
        self.state = state

    def row(self) -> tuple:
        for _ in range(CLOSING[self.state]):
            self.state = NEXT[self.state]
            self.add(Facts(), INSERT, "I", f"{ROLE[self.state]}:", self.state)
        f = self.facts
        return f.gaps, f.blank, f.duplicate, f.truncated, f.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


RESULT = [*((n, T.LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", T.StringType()), ("repaired_sha256", T.StringType())]
_FACTS = [(n, T.StringType() if n in ("first", "last") else T.LongType()) for n in Facts.NAMES]
_LISTS = [("roles", T.ArrayType(T.StringType())), ("texts", T.ArrayType(T.StringType())), ("gone", T.ArrayType(T.IntegerType())), ("edits", T.ArrayType(T.StringType()))]
_PATHS = [("costs", T.ArrayType(T.LongType())), ("ranks", T.ArrayType(T.IntegerType()))]
_PLACE = [("pid", T.LongType()), ("seq", T.LongType())]
_STATES = [("entry", T.IntegerType()), ("leave", T.IntegerType())]


def _schema(kind: T.DataType, *parts: list) -> T.StructType:
    return T.StructType([T.StructField("conv_id", kind), *(T.StructField(n, t) for p in parts for n, t in p)])


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _paths(solved: dict[int, tuple[dict[int, tuple[int, int]], Trail]]) -> tuple[list, list, list]:
    """cost, rank and edits of each pair (entry, leave) as lists of 16; a cost of -1 where there is no way."""
    cost, rank, edits = [-1] * 16, [-1] * 16, [None] * 16
    for e, (best, trail) in solved.items():
        for q, place in ranked(best, trail).items():
            cost[4 * e + q], rank[4 * e + q], edits[4 * e + q] = best[q][0], place, trail.text(best[q][1])
    return cost, rank, edits


def _pieces(kind: T.DataType):
    """Results of conversations of one chunk inside a sorted partition; all other conversations as chunks to be joined."""
    schema = _arrow(_schema(kind, [("whole", T.BooleanType())], RESULT, _PLACE, [("run", T.LongType())], _LISTS, _PATHS, [("f_" + n, t) for n, t in _FACTS]))

    def whole(conv, chunk: Chunk) -> tuple:
        trail, report = Trail(), Report()
        best = solve(chunk.rows(), 0, trail)
        order = ranked(best, trail)
        end = closed({q: (c, order[q]) for q, (c, _) in best.items()})
        edits = trail.text(best[end][1])
        lines = written(edits, 0, chunk.roles, chunk.texts, chunk.gone)
        report.add(chunk.facts, best[end][0], edits, "\n".join(lines) if lines else None, end)
        return (conv, True, *report.row(), *[None] * 18)

    def part(conv, chunk: Chunk, pid: int, seq: int) -> tuple:
        if chunk.run:
            same = [DELETE * chunk.run if e == q else -1 for e in range(4) for q in range(4)]
            paths = (None, same, [0 if c >= 0 else -1 for c in same])
        else:
            trail = Trail()
            cost, rank, edits = _paths({e: (solve(chunk.rows(), e, trail), trail) for e in range(4)})
            paths = (edits, cost, rank)
        return (conv, False, *[None] * 8, pid, seq, chunk.run, chunk.roles, chunk.texts, chunk.gone, *paths, *chunk.facts.values())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, seq, size = TaskContext.get().partitionId(), 0, 0
        out: list[tuple] = []
        conv, begun, first_one, parted, chunk = None, False, True, False, Chunk()

        def cut_off() -> None:
            """Hand on what there is of the conversation as a chunk."""
            nonlocal seq, size, parted, chunk
            if chunk.gone or chunk.run:
                out.append(part(conv, chunk, pid, seq))
                seq, size, parted, chunk = seq + 1, size + 20 * len(chunk.gone) + chunk.chars, True, Chunk()

        for batch in batches:
            for c, turn, role, text, n, first, blank, cut in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                if begun and c != conv:
                    # the first conversation of a partition may have begun, and the last go on, elsewhere
                    if first_one or parted:
                        cut_off()
                    else:
                        out.append(whole(conv, chunk))
                        size, chunk = size + 500, Chunk()
                    first_one, parted = False, False
                conv, begun = c, True
                stays = first and not blank
                for gone, fault in ((0, "truncated" if cut else None), (n - 1, "duplicate")) if stays else ((n, "blank" if blank else "duplicate"),):
                    if gone == 0 and fault == "duplicate":
                        continue
                    if gone > RUN or len(chunk.gone) >= CHUNK or chunk.chars >= CHARS:
                        cut_off()
                    chunk.add(turn, role, None if gone else text, cut, gone, fault)
                    if chunk.run:
                        cut_off()
                if size > CHARS:
                    yield _batch(out, schema)
                    out.clear()
                    size = 0
        cut_off()
        yield _batch(out, schema)

    return run


def _walk(children: list[dict], entry: int) -> tuple[dict[int, tuple[int, int]], list[dict[int, int]]]:
    """(cost, rank) by state after all children in order, and by child and state after it the state before."""
    now, back = {entry: (0, 0)}, []
    for child in children:
        new = {}
        for q in range(4):
            ways = [(c + child["costs"][4 * p + q], r, p) for p, (c, r) in now.items() if child["costs"][4 * p + q] >= 0]
            if ways:
                new[q] = min(ways)
        order = sorted(new, key=lambda q: (new[q][1], child["ranks"][4 * new[q][2] + q]))
        now = {q: (new[q][0], order.index(q)) for q in new}
        back.append({q: new[q][2] for q in new})
    return now, back


def _joined(kind: T.DataType):
    """Costs and ranks of the children of a branch taken together."""
    schema = _arrow(_schema(kind, [("key", T.LongType())], _PATHS))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        children = sorted(rows.select(["at", "costs", "ranks"]).to_pylist(), key=lambda r: r["at"])
        cost, rank = [-1] * 16, [-1] * 16
        for e in range(4):
            for q, (c, r) in _walk(children, e)[0].items():
                cost[4 * e + q], rank[4 * e + q] = c, r
        return pa.Table.from_batches([_batch([(key[0].as_py(), key[1].as_py(), cost, rank)], schema)])

    return run


def _parted(kind: T.DataType):
    """The states in which a branch's chosen path enters and leaves each child; a root's path is the best closed one."""
    schema = _arrow(_schema(kind, [("key", T.LongType()), ("at", T.LongType())], _STATES))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        children = sorted(rows.select(["at", "costs", "ranks", "entry", "leave"]).to_pylist(), key=lambda r: r["at"])
        entry, leave = children[0]["entry"], children[0]["leave"]
        now, back = _walk(children, 0 if entry is None else entry)
        state, out = closed(now) if leave is None else leave, []
        for child, before in zip(reversed(children), reversed(back), strict=True):
            out.append((key[0].as_py(), key[1].as_py(), child["at"], before[state], state))
            state = before[state]
        return pa.Table.from_batches([_batch(out, schema)])

    return run


def _reports(kind: T.DataType):
    """Results from chunks with their states, sorted by conversation and place."""
    schema = _arrow(_schema(kind, RESULT))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, report = None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if report is None or r["conv_id"] != conv:
                    if report is not None:
                        out.append((conv, *report.row()))
                    conv, report = r["conv_id"], Report()
                e, q = r["entry"], r["leave"]
                edits = "D" * r["run"] if r["run"] else r["edits"][4 * e + q]
                lines = [] if r["run"] else written(edits, e, r["roles"], r["texts"], r["gone"])
                report.add(Facts(*(r["f_" + n] for n in Facts.NAMES)), r["costs"][4 * e + q], edits, "\n".join(lines) if lines else None, q)
            yield _batch(out, schema)
        if report is not None:
            yield _batch([(conv, *report.row())], schema)

    return run


def repair(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation.

    conversations: conv_id, turn, role, text. Rows are taken by turn (nulls first), then role and text. A null role or text is one space; a
    null conv_id is a conversation; other columns are ignored; an empty table gives no rows. A row is blank without
    a character other than white space, a duplicate where its role and text stood before, truncated where its last
    such character is none of `.!?`. Blank rows and duplicates are deleted, truncated ones cost 3 unless deleted. An empty role has
    no initial and cannot be kept.
    """
    spark = conversations.sparkSession
    kind = conversations.schema["conv_id"].dataType
    keys = ["conv_id", "turn", "role", "text"]
    c = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(x, F.lit(" ")).alias(x) for x in ("role", "text")))
    alike = materialize(c.groupBy(keys).agg(F.count("*").alias("n")))
    # where a role and text stand first: marked by a row of count 0, so that no group of equal texts is gathered
    place = F.min(F.struct(F.col("turn").isNotNull(), "turn"))["turn"]
    first = alike.groupBy("conv_id", "role", "text").agg(place.alias("turn")).select(*keys, F.lit(0).cast("long").alias("n"), F.lit(True).alias("first"))
    rows = alike.withColumn("first", F.lit(False)).unionByName(first).groupBy(keys).agg(F.sum("n").alias("n"), F.max("first").alias("first"))
    rows = materialize(rows.select("*", (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    made = materialize(sorted_rows.mapInArrow(_pieces(kind), _schema(kind, [("whole", T.BooleanType())], RESULT, _PLACE, [("run", T.LongType())], _LISTS, _PATHS, [("f_" + n, t) for n, t in _FACTS])))
    discard(alike, rows)
    chunks = made.where(~F.col("whole"))
    # up: chunks of a partition, then 2 ** FAN partitions at a time
    levels = [chunks.select("conv_id", F.col("pid").alias("key"), F.col("seq").alias("at"), "costs", "ranks")]
    most = chunks.agg(F.max("pid")).first()[0] or 0
    while True:
        joined = levels[-1].groupBy("conv_id", "key").applyInArrow(_joined(kind), _schema(kind, [("key", T.LongType())], _PATHS))
        joined = materialize(joined.select("conv_id", F.shiftright("key", FAN).alias("key"), F.col("key").alias("at"), "costs", "ranks"))
        levels.append(joined)
        most >>= FAN
        if not most:
            break
    # down: the path of the whole conversation, then of each branch
    no = F.lit(None).cast("int")
    states = None
    for level in reversed(levels):
        if states is None:
            asked = level.withColumn("entry", no).withColumn("leave", no)
        else:
            of = states.select(F.col("conv_id").alias("_c"), F.col("at").alias("_k"), "entry", "leave")
            asked = level.join(of, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("key") == F.col("_k"))).drop("_c", "_k")
        before = [] if states is None else [states]
        states = materialize(asked.groupBy("conv_id", "key").applyInArrow(_parted(kind), _schema(kind, [("key", T.LongType()), ("at", T.LongType())], _STATES)))
        discard(*before)
    discard(*levels[1:])
    of = states.select(F.col("conv_id").alias("_c"), F.col("key").alias("_k"), F.col("at").alias("_a"), "entry", "leave")
    placed = chunks.join(of, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("pid") == F.col("_k")) & (F.col("seq") == F.col("_a"))).drop("_c", "_k", "_a")
    joined = placed.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "pid", "seq").mapInArrow(_reports(kind), _schema(kind, RESULT))
    return made.where("whole").select(joined.columns).unionByName(joined)


def damage(conversations: DataFrame) -> DataFrame:
    """conversations with a fault in every fourth row or so, by the crc32 of `conv_id:turn` modulo 20.

    0: the row is dropped; 1: its text is empty; 2: it lacks `.!?`; 3: it stands twice; 4: its role is `user`. Nulls are one space.
    """
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw: Column = F.crc32(F.concat(of("conv_id"), F.lit(":"), of("turn")).cast("binary")) % 20
    d = conversations.select("conv_id", "turn", of("role").alias("role"), of("text").alias("text"), draw.alias("_d")).where("_d <> 0")
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("_d") == 3, 2).otherwise(1)))
    return d.select("conv_id", "turn", F.when(F.col("_d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    done = repair(damage(rows)).withColumnRenamed("conv_id", "_c")
    every = rows.select("conv_id").distinct().join(done, F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    none = {n: F.lit(hashlib.sha256().hexdigest() if n == "repaired_sha256" else "" if n == "audit" else 0) for n, _ in RESULT}
    return every.select("conv_id", *(F.coalesce(n, none[n].cast(t)).alias(n) for n, t in RESULT))


def _sql_steps() -> str:
    """The steps as SQL rows: state before and after, initial that it takes (`*`: any), cost, edits, and the roles put in and given."""
    out = []
    for p in range(4):
        out.append((p, p, "*", DELETE, "D", "", ""))
        at, put = p, []
        for n in range(3):
            lines = "".join(f"{ROLE[x]}:|" for x in put)
            out += [(p, FOLLOWS[at, i], i, INSERT * n, "I" * n + "K", lines, "") for i in ("s", "u", "a") if (at, i) in FOLLOWS]
            at = NEXT[at]
            out.append((p, at, "*", INSERT * n + REROLE, "I" * n + "R", lines, ROLE[at]))
            put.append(at)
    return ", ".join(f"({p}, {q}, '{i}', {c}, '{e}', '{pre}', '{role}')" for p, q, i, c, e, pre, role in out)


#: crc32 goes byte by byte over the key; a step of the recursion takes one row, all four states at once as a list of (cost, audit, rows).
SQL = r"""
WITH RECURSIVE bits AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
), v AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), drawn AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS d FROM v, bits
), damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM drawn, range(2) copies(i) WHERE d <> 0 AND (i = 0 OR d = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, role[1:1] AS ini FROM damaged
), told AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault,
    lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS pair FROM placed
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM told GROUP BY conv_id
), steps AS (
  SELECT list({'p': p, 'q': q, 'i': i, 'c': c, 'e': e, 'put': put, 'role': role}) AS s FROM (VALUES STEPS) x(p, q, i, c, e, put, role)
), walk AS (
  SELECT conv_id, 0::BIGINT AS i, [{'c': 0, 'a': '', 'b': ''}, NULL, NULL, NULL] AS st FROM (SELECT DISTINCT conv_id FROM told)
  UNION ALL
  SELECT w.conv_id, r.i, list_transform([0, 1, 2, 3], lambda q: list_min(list_transform(list_filter(s, lambda x: x.q = q AND st[x.p + 1] IS NOT NULL
      AND (x.e = 'D' OR (r.fault NOT IN ('b', 'd') AND (x.i = '*' OR x.i = r.ini)))),
    lambda x: {'c': st[x.p + 1].c + x.c + CASE WHEN r.fault = 't' AND x.e <> 'D' THEN 3 ELSE 0 END, 'a': st[x.p + 1].a || x.e,
      'b': st[x.p + 1].b || CASE WHEN x.e = 'D' THEN '' ELSE replace(x.put, '|', chr(10)) || CASE WHEN x.role = '' THEN r.role ELSE x.role END || ':' || r.text || chr(10) END}))) AS st
  FROM walk w JOIN told r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1, steps
), last AS (
  SELECT conv_id, list_min([st[1], st[4],
    CASE WHEN st[2] IS NOT NULL THEN {'c': st[2].c + 6, 'a': st[2].a || 'II', 'b': st[2].b || 'user:' || chr(10) || 'assistant:' || chr(10)} END,
    CASE WHEN st[3] IS NOT NULL THEN {'c': st[3].c + 3, 'a': st[3].a || 'I', 'b': st[3].b || 'assistant:' || chr(10)} END]) AS x
  FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(x.c, 0) AS BIGINT) AS cost, coalesce(x.a, '') AS audit, sha256(coalesce(x.b[1:length(x.b) - 1], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN last l ON l.conv_id IS NOT DISTINCT FROM o.conv_id
""".replace("STEPS", _sql_steps())
