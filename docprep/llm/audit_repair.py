"""Repair of conversation structure: the cheapest edits that give role initials ``(s?(ua)+)?``.

The rows of a conversation are read in order of turn. A dynamic programme over four states (nothing
yet, after the system row, after a user row, after an assistant row) keeps for each state the cheapest
edits and, of equally cheap ones, the ASCII-least string of their initials (the audit). Audits are persistent: an
edit is a node linked to the node before it, so states share their prefixes. A node holds a
rolling hash of its audit and its ancestors at distances 1, 2, 4, ..., so two audits are compared by a search
for their longest common prefix over ancestors; prefixes whose hashes agree are then compared edit by edit up to a shared node.

Two audits of one state and cost never are each other's prefix (edits after the same rows would
differ in inserts alone, which cost), so a lesser prefix stays the lesser one whatever follows.

Conversations of at most ``max_rows`` rows and ``max_bytes`` bytes are read one at a time by the tasks that
a shuffle by conversation gives them to. A longer one never comes into one task's memory: it is cut in blocks of rows, a task finds
a block's best audits for every state before it and after it, the blocks' audits are joined in the same
way (a node a block), and its repaired rows stream through a hash in order.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docprep.llm.common import materialise

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5  # costs; the last one is added for truncated rows not deleted
MAX_ROWS = 4_096
MAX_BYTES = 64 * 1024 * 1024
BLOCK_ROWS = 2_048
BLANK, DUPLICATE, CUT = 1, 2, 3  # a row's first fault; 0: none
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
# state -> (initial that may come next, state after it)
NEXT = {NOTHING: (("s", SYSTEM), ("u", USER)), SYSTEM: (("u", USER),), USER: (("a", ASSISTANT),), ASSISTANT: (("u", USER),)}
_BASE, _MOD = 1_000_003, (1 << 61) - 1
_SPACE = " \t\n\v\f\r"


class Node:
    """The last edit of an audit; ``ups[k]`` is the node 2^k edits before."""

    __slots__ = ("label", "depth", "hash", "ups")

    def __init__(self, before: "Node | None", label: str):
        self.label = label
        if before is None:
            self.depth, self.hash, self.ups = 0, 0, ()
            return
        self.depth = before.depth + 1
        self.hash = (before.hash * _BASE + (ord(label) if len(label) == 1 else hash(label))) % _MOD
        ups, up = [before], before
        while len(up.ups) >= len(ups):
            up = up.ups[len(ups) - 1]
            ups.append(up)
        self.ups = tuple(ups)

    def at(self, depth: int) -> "Node":
        node, left = self, self.depth - depth
        while left:
            k = left.bit_length() - 1
            node = node.ups[k]
            left -= 1 << k
        return node

    def labels(self) -> list[str]:
        out, node = [], self
        while node.ups:
            out.append(node.label)
            node = node.ups[0]
        return out[::-1]


def _same(a: Node, b: Node) -> bool:
    """Whether two audits of one depth are equal: by hash, then edit by edit up to a node they share."""
    if a.hash != b.hash:
        return False
    while a is not b:
        if a.label != b.label:
            return False
        a, b = a.ups[0], b.ups[0]
    return True


def less(a: Node, b: Node) -> bool:
    """Whether audit ``a`` comes before audit ``b``: the first edit after their longest common prefix decides."""
    x, y = (n.at(min(a.depth, b.depth)) for n in (a, b))
    if _same(x, y):
        return a.depth < b.depth
    # x and y stay different; climb while the ancestors differ too
    for k in range(x.depth.bit_length(), -1, -1):
        if k < len(x.ups) and not _same(x.ups[k], y.ups[k]):
            x, y = x.ups[k], y.ups[k]
    return x.label < y.label


def _better(cost: int, before: Node, label: str, best: tuple | None) -> tuple:
    """The better of ``best`` (cost, node before, label) and a new candidate."""
    if best is None or cost < best[0]:
        return cost, before, label
    if cost == best[0] and (before is not best[1] or label < best[2]):
        if before is best[1] or less(Node(before, label), Node(best[1], best[2])):
            return cost, before, label
    return best


def _inserted(cells: dict[int, tuple[int, Node]]) -> dict[int, tuple[int, Node]]:
    """States reached by any number of inserts (two in a row lead back to the same kind of state)."""
    cells = dict(cells)
    for sources, goal in (((NOTHING, SYSTEM, ASSISTANT), USER), ((USER,), ASSISTANT)):
        best = None
        if goal in cells:
            cost, node = cells[goal]
            best = (cost, node, None)
        for s in sources:
            if s in cells:
                cost, node = cells[s][0] + INSERT, cells[s][1]
                if best is None or cost < best[0]:
                    best = (cost, node, "I")
                elif cost == best[0] and less(Node(node, "I"), best[1] if best[2] is None else Node(best[1], best[2])):
                    best = (cost, node, "I")
        if best and best[2]:
            cells[goal] = best[0], Node(best[1], "I")
    return cells


def step(cells: dict[int, tuple[int, Node]], initial: str, fault: int) -> dict[int, tuple[int, Node]]:
    """Cells after one row more."""
    cells = _inserted(cells)
    best: dict[int, tuple] = {}
    for state, (cost, node) in cells.items():
        best[state] = _better(cost + DELETE, node, "D", best.get(state))
        if fault in (BLANK, DUPLICATE):
            continue
        extra = cost + (TRUNCATED if fault == CUT else 0)
        for wanted, after in NEXT[state]:
            if wanted == initial:
                best[after] = _better(extra + KEEP, node, "K", best.get(after))
            elif wanted != "s":
                best[after] = _better(extra + REROLE, node, "R", best.get(after))
    return {s: (cost, Node(node, label)) for s, (cost, node, label) in best.items()}


def _ended(cells: dict[int, tuple[int, Node]]) -> tuple[int, Node]:
    """Cheapest cell that may end a conversation."""
    cells = _inserted(cells)
    ends = [cells[s] for s in (NOTHING, ASSISTANT) if s in cells]
    best = ends[0]
    for cell in ends[1:]:
        if cell[0] < best[0] or (cell[0] == best[0] and less(cell[1], best[1])):
            best = cell
    return best


def cheapest(rows: list[tuple[str, int]]) -> tuple[int, str]:
    """(cost, audit) of a conversation's rows (role initial, fault)."""
    cells = {NOTHING: (0, Node(None, ""))}
    for initial, fault in rows:
        cells = step(cells, initial, fault)
    cost, node = _ended(cells)
    return cost, "".join(node.labels())


class Repaired:
    """Applies an audit to the rows in order; ``lines`` yields the repaired ``(role, text)``."""

    def __init__(self, state: int = NOTHING):
        self.state = state

    def _add(self, role: str) -> None:
        self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[:1]]

    def lines(self, audit: str, rows):
        rows = iter(rows)
        for edit in audit:
            wanted = "assistant" if self.state == USER else "user"
            if edit == "I":
                self._add(wanted)
                yield wanted, ""
                continue
            role, text = next(rows)
            if edit == "D":
                continue
            role = wanted if edit == "R" else role
            self._add(role)
            yield role, text


class _Digest:
    """SHA-256 of newline-joined ``role:text`` lines."""

    def __init__(self):
        self.sha, self.some = hashlib.sha256(), False

    def add(self, lines):
        for role, text in lines:
            self.sha.update((b"\n" if self.some else b"") + f"{role}:{text}".encode())
            self.some = True


def blank_or_cut(text: str) -> int:
    shown = text.rstrip(_SPACE)
    return BLANK if not shown else 0 if shown[-1] in ".!?" else CUT


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_REPORT = [("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())]


def report(conv_id, rows: list[tuple]) -> tuple:
    """Report of one conversation from its ordered rows (turn, role, text)."""
    seen, faults, initials = set(), [], []
    for _, role, text in rows:
        fault = blank_or_cut(text)
        if fault != BLANK and (role, text) in seen:
            fault = DUPLICATE
        seen.add((role, text))
        faults.append(fault)
        initials.append(role[:1])
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    cost, audit = cheapest(list(zip(initials, faults)))
    digest = _Digest()
    digest.add(Repaired().lines(audit, [r[1:] for r in rows]))
    return conv_id, gaps, faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT), _illegal(initials), cost, audit, digest.sha.hexdigest()


def _batch(rows: list[tuple], kind: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kind)], [n for n, _ in kind])


def _groups(batches, width: int):
    """(key, row) of sorted batches whose first ``width`` columns are the key."""
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            yield row[:width], row[width:]


_ORDER = ("turn", "role", "text")  # ascending: nulls come first


def _short_reports(rows: DataFrame) -> DataFrame:
    def run(batches):
        key, pile, out = None, [], []
        for k, row in _groups(batches, 1):
            if k != key and pile:
                out.append(report(key[0], pile))
                pile = []
                if len(out) >= 2_000:
                    yield _batch(out, _REPORT)
                    out = []
            key = k
            pile.append(row)
        if pile:
            out.append(report(key[0], pile))
        if out:
            yield _batch(out, _REPORT)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *_ORDER).mapInArrow(run, REPORT)


_BLOCK = [("conv_id", pa.int64()), ("block", pa.int64()), ("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]


def _block_audits(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, block, at, initial, fault)`` -> the best audit of each block from every state before to every state after."""

    def solved(key, pile):
        for before in range(4):
            cells = {before: (0, Node(None, ""))}
            for _, initial, fault in pile:
                cells = step(cells, initial, fault)
            for after, (cost, node) in cells.items():
                yield *key, before, after, cost, "".join(node.labels())

    def run(batches):
        key, pile = None, []
        for k, row in _groups(batches, 2):
            if k != key and pile:
                yield _batch(list(solved(key, pile)), _BLOCK)
                pile = []
            key = k
            pile.append(row)
        if pile:
            yield _batch(list(solved(key, pile)), _BLOCK)

    dealt = rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "at")
    return dealt.mapInArrow(run, "conv_id long, block long, before int, after int, cost long, audit string")


class _Part(str):
    """A block's part of an audit as one label, with the block and the states around it."""

    block = before = after = None


_CHOSEN = [("conv_id", pa.int64()), ("block", pa.int64()), ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]


def _joined_audits(blocks: DataFrame) -> DataFrame:
    """``(conv_id, block, state, cost, audit)``: each block's part of its conversation's audit, the state before it and the whole
    cost. The edits after the last row are a part of their own, whose block is null."""

    def chosen(key, cells):
        cost, node = _ended(cells)
        labels = node.labels()
        parts = [x for x in labels if isinstance(x, _Part)]
        out = [(key[0], x.block, x.before, cost, str(x)) for x in parts]
        return [*out, (key[0], None, parts[-1].after, cost, "".join(labels[len(parts) :]))]

    def run(batches):
        key, block, cells, best = None, None, None, {}

        def close():
            return {s: (cost, Node(node, label)) for s, (cost, node, label) in best.items()}

        for (conv,), (k, before, after, cost, audit) in _groups(batches, 1):
            if key is None or conv != key[0]:
                if key is not None:
                    yield _batch(chosen(key, close()), _CHOSEN)
                key, block, cells, best = (conv,), k, {NOTHING: (0, Node(None, ""))}, {}
            elif k != block:
                cells, block, best = close(), k, {}
            if before in cells:
                label = _Part(audit)
                label.block, label.before, label.after = k, before, after
                best[after] = _better(cells[before][0] + cost, cells[before][1], label, best.get(after))
        if key is not None:
            yield _batch(chosen(key, close()), _CHOSEN)

    dealt = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "block", "before", "after")
    return dealt.mapInArrow(run, "conv_id long, block long, state int, cost long, audit string")


def _streamed_hashes(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """``(conv_id, repaired_sha256, audit)``: rows and edits in order through one running hash."""

    def run(batches):
        kind = [("conv_id", pa.int64()), ("repaired_sha256", pa.string()), ("audit", pa.string())]
        key, digest, audits, fixer, edits, at = None, None, [], None, "", 0
        for (conv, *_), (part, state, audit, role, text) in _groups(batches, 1):
            if key is None or (conv,) != key:
                if key is not None:
                    yield _batch([(key[0], digest.sha.hexdigest(), "".join(audits))], kind)
                key, digest, audits = (conv,), _Digest(), []
            if part == 0:
                fixer, edits, at = Repaired(state), audit, 0
                audits.append(audit)
                if not audit.strip("I"):
                    digest.add(fixer.lines(audit, ()))
                continue
            stop = at
            while edits[stop] == "I":
                stop += 1
            digest.add(fixer.lines(edits[at : stop + 1], [(role, text)]))
            at = stop + 1
        if key is not None:
            yield _batch([(key[0], digest.sha.hexdigest(), "".join(audits))], kind)

    last = F.lit((1 << 63) - 1)
    edits = chosen.select("conv_id", F.coalesce("block", last).alias("block"), F.lit(-1).cast("long").alias("at"), F.lit(0).alias("part"), "state", "audit")
    both = edits.unionByName(rows.select("conv_id", "block", "at", F.lit(1).alias("part"), "role", "text"), allowMissingColumns=True)
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "block", "part", "at")
    return both.select("conv_id", "part", "state", "audit", "role", "text").mapInArrow(run, "conv_id long, repaired_sha256 string, audit string")


def _long_reports(rows: DataFrame, block_rows: int) -> DataFrame:
    """Reports of conversations of any length, without one in a task's memory."""
    place = F.monotonically_increasing_id()
    cut = rows.sparkSession.sparkContext.defaultParallelism * 2
    # equal rows are one key: a number of their own deals them to several ranges
    src = materialise(rows.withColumn("own", place), "long_rows")
    # a null conversation has a key of its own
    src = src.select(F.col("conv_id").isNotNull().alias("named"), F.coalesce("conv_id", F.lit(0)).alias("conv"), "turn", "role", "text", "own")
    order = ["named", "conv", *_ORDER, "own"]
    ranged = src.repartitionByRange(cut, *order).sortWithinPartitions(*order).withColumn("at", place)
    last = F.substring(F.rtrim("text", F.lit(_SPACE)), -1, 1)  # the last character shown
    ranged = ranged.withColumn("last", last).withColumn("same", F.sha2(F.concat(F.sha2("role", 256), F.lit(":"), "text"), 256))
    ranged = materialise(ranged, "long_ordered")
    conv = ["named", "conv"]
    # rows of a role and text seen earlier in the conversation
    first = ranged.where("last <> ''").groupBy(*conv, "same").agg(F.min("at").alias("first"), F.max("at").alias("latest")).where("first < latest")
    again = ranged.select(*conv, "same", "at").join(first, [*conv, "same"]).where("at > first").select("at", F.lit(True).alias("again"))
    fault = F.when(F.col("last") == "", BLANK).when(F.coalesce("again", F.lit(False)), DUPLICATE).when(~F.col("last").isin(".", "!", "?"), CUT).otherwise(0)
    block = F.expr(f"at div {block_rows}").alias("block")
    conv_id = F.when(F.col("named"), F.col("conv")).alias("conv_id")
    narrow = ranged.select(conv_id, block, "at", "turn", F.substring("role", 1, 1).alias("initial"), "last")
    narrow = materialise(narrow.join(again, "at", "left").withColumn("fault", fault.cast("int")).drop("last", "again"), "long_narrow")
    chosen = materialise(_joined_audits(_block_audits(narrow.select("conv_id", "block", "at", "initial", "fault"))), "long_audits")
    hashes = _streamed_hashes(ranged.select(conv_id, block, "at", "role", "text"), chosen)

    # neighbours: inside a block by a window, between blocks by the blocks' first and last initials
    def pairs(w: Window, before: str, own: str):
        pair = F.concat(F.lag(before).over(w), F.col(own))
        return F.when(F.lag(before).over(w).isNotNull() & ~pair.isin("su", "ua", "au"), 1).otherwise(0)

    inside = narrow.withColumn("bad", pairs(Window.partitionBy("conv_id", "block").orderBy("at"), "initial", "initial"))
    faults = [F.count_if(F.col("fault") == k).alias(n) for k, n in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (CUT, "truncated"))]
    ends = [F.min_by("initial", "at").alias("head"), F.max_by("initial", "at").alias("tail"), F.min("turn").alias("lo"), F.max("turn").alias("hi")]
    blocks = inside.groupBy("conv_id", "block").agg(*faults, F.sum("bad").alias("bad"), *ends)
    blocks = blocks.withColumn("joint", pairs(Window.partitionBy("conv_id").orderBy("block"), "tail", "head"))
    per = blocks.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "bad", "joint")), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    turns = narrow.where("turn is not null").select("conv_id", "turn").distinct().groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))
    whole = chosen.where("block is null").select("conv_id", "cost")
    out = per
    for other in (turns, whole, hashes):
        other = other.withColumnRenamed("conv_id", "other_id")
        out = out.join(other, F.col("conv_id").eqNullSafe(F.col("other_id")), "left").drop("other_id")
    gaps = F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("turns"), F.lit(0))
    return out.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", (F.col("bad") + F.col("joint")).alias("illegal"), "cost", "audit", "repaired_sha256")


def repaired(conversations: DataFrame, every: DataFrame | None = None, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A row per conversation of ``conversations(conv_id, turn, role, text)``, and per further ``conv_id`` of ``every``:
    ``gaps`` (turns missing between the least and the greatest), ``blank``, ``duplicate`` and ``truncated`` rows (a row counts for the first that
    holds), ``illegal`` neighbours, ``cost`` of the cheapest edits, their ``audit`` and the SHA-256 of the repaired ``role:text`` lines.

    Rows are read by turn, nulls first; rows of one turn by role and text, repeated rows one after another. A null role
    or text counts as one space; rows with a null conv_id are a conversation of their own. Other columns are
    ignored. A conversation without rows has zeros, an empty audit and the hash of nothing; no conversations give an empty result.
    """
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), one("role"), one("text"))
    size = F.sum(F.octet_length("text") + F.octet_length("role"))
    sizes = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), size.alias("b"))
    many = materialise(sizes.where((F.col("n") > max_rows) | (F.col("b") > max_bytes)).select(F.col("conv_id").alias("long_id")), "long_ids")
    if many.isEmpty():
        out = _short_reports(rows)
    else:
        is_long = F.col("conv_id").eqNullSafe(F.col("long_id"))
        out = _short_reports(rows.join(many, is_long, "left_anti")).unionByName(_long_reports(rows.join(many, is_long, "left_semi"), block_rows))
    if every is None:
        return out
    out = materialise(out, "reports")
    ids = every.select(F.col("conv_id").cast("long").alias("any_id")).distinct()
    missing = ids.join(out.select("conv_id"), F.col("any_id").eqNullSafe(F.col("conv_id")), "left_anti")
    zero = F.lit(0).cast("long")
    none = missing.select(
        F.col("any_id").alias("conv_id"), *(zero.alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.lit("").alias("audit"), F.lit(hashlib.sha256().hexdigest()).alias("repaired_sha256"),
    )
    return out.unionByName(none)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows damaged by ``crc32(conv_id:turn) % 20``: 0 drops one, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes its role user.

    A null counts as one space, in the key, the role and the text.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")
