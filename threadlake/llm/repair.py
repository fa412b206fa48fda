"""Conversation structure repair by rank-convergence parallel Viterbi.

A conversation, read by turn, is repaired so that the initials of its roles read ``(s?(ua)+)?``: rows
are kept (no cost), given the role user or assistant (3), deleted (4), and empty user or assistant
turns are put in between (3). Blank rows and rows said before are always deleted; a truncated row
that stays costs 3 more. Of the cheapest repairs the one whose edits, written as K, R, D and I in
order, come first in ASCII is taken.

The rows are sorted by conversation and turn over all tasks, so one conversation may go on through
any number of parts. Its cost vectors (cheapest rest from each of four states) run backwards and a
part does not know the vector at its end until the next part is done. So every such part starts from
a speculative vector of zeros. Fix-up passes then rerun the parts whose speculated vector differs from
what the next part found by more than a constant; a rerun stops at the row where the old and the new
vector differ by a constant only, as from there on the old results hold. Rows that are deleted anyway
leave the vectors alone and are skipped. Should parts still differ after ``MAX_PASSES`` passes, they
are run once from each of the four unit vectors, which together give the part's result for any end.
With the stitched vectors each part says in which state it leaves for each state it is entered in,
the entries follow, and every part traces its least edits. The driver holds a few numbers a part.

Order. Rows of one turn are ordered by role, then by the MD5 of role and text; rows without turn come
first. Rows equal in all of these are carried once with their number.

Cases. Null role or text: one space (so such a text is blank). Null conversation: one conversation of
its own. Empty role: no initial, so the row is given a role or deleted. Repeated rows: the first is
judged, the others are duplicates. Very long texts: only sorted and joined, never in the search.
Empty table: no rows. Extra columns: ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlake.session import materialize

# Rows of a part, on average; a part is searched by one task.
PART_ROWS = 1 << 17
MAX_PASSES = 8
RELABEL, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
# States: nothing said yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = (USER, USER, ASSISTANT, USER)
_ROLE = {USER: "user", ASSISTANT: "assistant"}
FAR = 1 << 40  # no way
END = (0, 2 * INSERT, INSERT, 0)  # cheapest rest after the last row
UNKNOWN = (0, 0, 0, 0)
_SPACES = " \t\n\x0b\x0c\r"

Vector = tuple[int, int, int, int]


def options(state: int, initial: str, cut_off: bool) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) of a row that need not be deleted, in ASCII order."""
    extra = CUT_OFF * cut_off
    out = [("D", DELETE, state)]
    if initial == "s" and state == START:
        out.append(("K", extra, SYSTEM))
    elif initial == "u" and state != USER:
        out.append(("K", extra, USER))
    elif initial == "a" and state == USER:
        out.append(("K", extra, ASSISTANT))
    return [*out, ("R", RELABEL + extra, _NEXT[state])]


def before(after: Vector, initial: str, cut_off: bool) -> Vector:
    """Cost vector in front of a row (inserted turns included) from the one behind it."""
    row = [min(cost + after[to] for _, cost, to in options(state, initial, cut_off))
           for state in range(4)]
    out = [min(row[s], INSERT + row[_NEXT[s]]) for s in range(4)]
    # two inserted turns in a row
    return tuple(min(out[s], 2 * INSERT + row[_NEXT[_NEXT[s]]]) for s in range(4))


class Machine:
    """Cost vectors over rows given as codes: 2 x initial's place in "sua-" + truncated."""

    def __init__(self) -> None:
        self.known: dict[tuple[Vector, int], tuple[Vector, int]] = {}

    def back(self, vector: Vector, code: int) -> tuple[Vector, int]:
        """Normalised vector in front of a row and what was taken off; ``vector`` is normalised."""
        key = (vector, code)
        if key not in self.known:
            found = before(vector, "sua-"[code >> 1], bool(code & 1))
            least = min(found)
            self.known[key] = tuple(min(FAR, x - least) for x in found), least
        return self.known[key]

    def run(self, codes: list[int], end: Vector) -> Vector:
        """Vector at the start of the rows, up to a constant."""
        vector = normal(end)
        for code in reversed(codes):
            vector, _ = self.back(vector, code)
        return vector

    def rerun(self, codes: list[int], old_end: Vector, old_start: Vector, end: Vector) -> Vector:
        """``run`` from a new end; stops where the vectors of the old end differ by a constant."""
        old, new = normal(old_end), normal(end)
        for code in reversed(codes):
            if old == new:
                return old_start
            old, new = self.back(old, code)[0], self.back(new, code)[0]
        return new

    def basis(self, codes: list[int]) -> np.ndarray:
        """(state at the start, state at the end): cheapest way through the rows."""
        out = np.zeros((4, 4), np.int64)
        for state in range(4):
            vector, total = tuple(0 if s == state else FAR for s in range(4)), 0
            for code in reversed(codes):
                vector, least = self.back(vector, code)
                total += least
            out[:, state] = [min(FAR, x + total) for x in vector]
        return out

    def vectors(self, codes: list[int], end: Vector) -> list[Vector]:
        """Vectors behind each row; normalised, which leaves the choice of edits alone."""
        out = [normal(end)]
        for code in reversed(codes[1:]):
            out.append(self.back(out[-1], code)[0])
        return out[::-1]

    def trace(self, codes: list[int], after: list[Vector], state: int):
        """Least edits from ``state``: for each row (inserted roles before it, edit, state behind)."""
        for code, rest in zip(codes, after):
            initial, cut_off = "sua-"[code >> 1], bool(code & 1)
            front, least = self.back(rest, code)
            inserted = ""
            while True:
                ways = {e: (cost + rest[to], to) for e, cost, to in options(state, initial, cut_off)}
                best = front[state] + least
                if ways["D"][0] != best and INSERT + front[_NEXT[state]] + least == best:
                    state = _NEXT[state]
                    inserted += "sua"[state - 1]
                    continue
                edit = next(e for e in "DKR" if e in ways and ways[e][0] == best)
                state = ways[edit][1]
                break
            yield inserted, edit, state


def normal(vector) -> Vector:
    least = min(vector)
    return tuple(int(min(FAR, x - least)) for x in vector)


def ending(state: int) -> str:
    """Roles inserted after the last row."""
    out = ""
    while state in (SYSTEM, USER):
        state = _NEXT[state]
        out += "sua"[state - 1]
    return out


def faulty(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """``conv, turn, role, text, key, copies, fault``: distinct rows with the fault of the first copy."""
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"),
                        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
                        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"))
    rows = rows.withColumn("key", F.md5(F.concat(
        F.length("role").cast("string"), F.lit(":"), "role", "text")))
    rows = materialize(rows.groupBy("conv", "turn", "key").agg(
        F.min("role").alias("role"), F.min("text").alias("text"),
        F.count(F.lit(1)).alias("copies")), "turns")
    first = rows.groupBy(F.col("conv").alias("c"), F.col("key").alias("k")).agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("numbered"), "turn")).alias("first"))
    told = F.rtrim("text", F.lit(_SPACES))
    said = ~F.struct(F.col("turn").isNotNull().alias("numbered"), "turn").eqNullSafe(F.col("first"))
    return rows.join(first, (F.col("key") == F.col("k")) & F.col("conv").eqNullSafe(F.col("c"))).select(
        *rows.columns, F.when(told == "", BLANK).when(said, DUPLICATE).when(
            ~F.substring(told, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(0).alias("fault"))


def _codes(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the conversation, code of each row in order, and whether the row is searched."""
    conv = table["conv"].combine_chunks().dictionary_encode()
    conv = (conv if isinstance(conv, pa.DictionaryArray) else conv.combine_chunks()).indices
    number = pc.fill_null(conv, -1).to_numpy(zero_copy_only=False)
    segment = np.cumsum(np.diff(number, prepend=number[0] if len(number) else 0) != 0)
    fault = table["fault"].to_numpy()
    code = 2 * table["initial"].to_numpy() + (fault == TRUNCATED)
    return segment, code, (fault != BLANK) & (fault != DUPLICATE)


def _segment(table: pa.Table, last: bool) -> list[int]:
    """Codes of the searched rows of a part's first or last conversation."""
    segment, code, searched = _codes(table.sort_by("seq"))
    return code[searched & (segment == (segment[-1] if last else segment[0]))].tolist()


_NUMBERS = "part int, kind string, numbers array<bigint>"


def _number_rows(part: int, kind: str, rows) -> pa.Table:
    return pa.table({"part": pa.array([part], pa.int32()), "kind": [kind],
                     "numbers": pa.array([list(map(int, rows))], pa.list_(pa.int64()))})


def _runs(jobs: dict[int, tuple]):
    """Start vectors of the first conversation of parts: job is (end,) or (old end, old start, end)."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        part, machine = key[0].as_py(), Machine()
        codes, job = _segment(table, False), jobs[part]
        found = machine.run(codes, *job) if len(job) == 1 else machine.rerun(codes, *job)
        return _number_rows(part, "start", found)

    return run


def _bases(key: tuple, table: pa.Table) -> pa.Table:
    return _number_rows(key[0].as_py(), "basis", Machine().basis(_segment(table, False)).ravel())


def _exits(ends: dict[int, Vector]):
    """For each state at its start, the state at the end of the part's last conversation."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        part, machine = key[0].as_py(), Machine()
        codes = _segment(table, True)
        after = machine.vectors(codes, ends[part]) if codes else []
        out = []
        for state in range(4):
            for _, _, state in machine.trace(codes, after, state):
                pass
            out.append(state)
        return _number_rows(part, "exit", out)

    return run


def _edits(ends: dict[int, Vector], entries: dict[int, int]):
    """``seq, inserted, edit, role, ending`` of every row of a part."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        part, machine = key[0].as_py(), Machine()
        table = table.sort_by("seq")
        segment, code, searched = _codes(table)
        size = len(segment)
        inserted, edit, role, tail = [""] * size, ["D"] * size, [None] * size, [""] * size
        firsts = np.flatnonzero(np.diff(segment, prepend=-1))
        for first, stop in zip(firsts.tolist(), [*firsts[1:].tolist(), size]):
            rows = np.flatnonzero(searched[first:stop]) + first
            codes = code[rows].tolist()
            closed = stop < size or part not in ends
            after = machine.vectors(codes, END if closed else ends[part]) if codes else []
            state = entries.get(part, START) if first == 0 else START
            for i, (new, letter, state) in zip(rows.tolist(), machine.trace(codes, after, state)):
                inserted[i], edit[i] = new, letter
                if letter == "R":
                    role[i] = _ROLE[state]
            if closed:
                tail[stop - 1] = ending(state)
        return pa.table({"seq": table["seq"], "inserted": pa.array(inserted, pa.string()),
                         "edit": pa.array(edit, pa.string()), "new_role": pa.array(role, pa.string()),
                         "ending": pa.array(tail, pa.string())})

    return run


def _on_parts(rows: DataFrame, parts, function) -> dict[int, list[int]]:
    """Numbers that a function gives for some of the parts."""
    if not parts:
        return {}
    found = rows.where(F.col("part").isin(sorted(parts))).groupBy("part").applyInArrow(
        function, _NUMBERS).collect()  # at most sixteen numbers a part
    return {r["part"]: r["numbers"] for r in found}


def stitch(rows: DataFrame, max_passes: int = MAX_PASSES) -> tuple[dict[int, Vector], dict[int, int]]:
    """For parts whose last conversation goes on, its vector at the end; for the next part, the state
    in which its first conversation is entered.

    ``rows`` has ``part, seq, conv, initial, fault``, sorted by conversation over the parts.
    """
    edges = sorted(rows.groupBy("part").agg(
        F.min_by(F.struct("conv"), "seq").alias("first"),
        F.max_by(F.struct("conv"), "seq").alias("last")).collect())  # two keys a part
    following = {a["part"]: b["part"] for a, b in zip(edges, edges[1:]) if a["last"] == b["first"]}
    through = {e["part"] for e in edges if e["part"] in following and e["first"] == e["last"]}
    entered = set(following.values())
    used = {p: UNKNOWN if p in through else END for p in entered}
    starts = {p: normal(v) for p, v in _on_parts(
        rows, entered, _runs({p: (end,) for p, end in used.items()})).items()}
    for _ in range(max_passes):
        stale = {p for p in through & entered if normal(used[p]) != starts[following[p]]}
        if not stale:
            break
        now = {p: starts[following[p]] for p in stale}
        found = _on_parts(rows, stale, _runs({p: (used[p], starts[p], now[p]) for p in stale}))
        used |= now
        starts |= {p: normal(v) for p, v in found.items()}
    else:
        loose = {p for p in through & entered if normal(used[p]) != starts[following[p]]}
        held = loose and through & entered  # parts before a loose one may follow from it
        bases = {p: np.array(v).reshape(4, 4) for p, v in _on_parts(rows, held, _bases).items()}
        for p in sorted(bases, reverse=True):
            starts[p] = normal((bases[p] + np.array(starts[following[p]])).min(axis=1))
    ends = {p: starts[q] for p, q in following.items()}
    exits = _on_parts(rows, set(following), _exits(ends))
    entries: dict[int, int] = {}
    for p in sorted(following):
        entries[following[p]] = exits[p][entries[p] if p in through and p in entries else START]
    return ends, entries


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text", part_rows: int = PART_ROWS, max_passes: int = MAX_PASSES) -> DataFrame:
    """The edits of every distinct row, in the order of ``seq``.

    ``conv, seq, turn, role, text, copies, fault`` (of the first copy; the others are duplicates and
    deleted after it), ``inserted`` (initials of the turns put before it), ``edit`` (K, R or D),
    ``new_role`` (of an R), ``ending`` (initials of turns put after the conversation's last row).
    """
    found = materialize(faulty(turns, conv, turn, role, text), "faults")
    spark = found.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                -(-found.count() // part_rows))
    order = ["conv", "turn", "role", "key"]
    stored = materialize(found.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumns({
        "part": F.spark_partition_id(), "seq": F.monotonically_increasing_id(),
        "initial": F.coalesce(F.when(F.col("role").startswith("s"), 0).when(
            F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2), F.lit(3))}),
        "sorted")
    rows = stored.select("part", "seq", "conv", "initial", "fault")
    ends, entries = stitch(rows, max_passes)
    edits = rows.groupBy("part").applyInArrow(
        _edits(ends, entries),
        "seq bigint, inserted string, edit string, new_role string, ending string")
    return stored.select("conv", "seq", "turn", "role", "text", "copies", "fault").join(
        edits, "seq").select("conv", "seq", "turn", "role", "text", "copies", "fault", "inserted",
                             "edit", "new_role", "ending")


def repaired(edits: DataFrame) -> DataFrame:
    """``conv, seq, place, role, text``: the repaired conversations of ``repair``."""
    put = ("transform(filter(split({0}, ''), x -> x <> ''), x -> named_struct("
           "'role', CASE x WHEN 'u' THEN 'user' ELSE 'assistant' END, 'text', ''))")
    own = F.filter(F.array(F.struct(F.coalesce("new_role", "role").alias("role"), "text")),
                   lambda _: F.col("edit") != "D")
    return edits.select("conv", "seq", F.posexplode(F.concat(
        F.expr(put.format("inserted")), own, F.expr(put.format("ending")))).alias("place", "turn")).select(
        "conv", "seq", "place", "turn.role", "turn.text")


def damage(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """``conv, turn, role, text`` with faults that the CRC-32 of conversation and turn decides."""
    def said(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(said(conv), F.lit(":"), said(turn)).cast("binary")) % 20
    words = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said(text), "[.!?]", "")).otherwise(
        said(text))
    return turns.where(kind != 0).select(
        F.col(conv).alias(conv), F.col(turn).alias(turn),
        F.when(kind == 4, "user").otherwise(said(role)).alias(role), words.alias(text),
        F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias(
            "copy")).drop("copy")


def _tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation of rows sorted by conversation and place."""
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
             "repaired_sha256"]
    now, conv_type = None, None

    def done():
        turns = now["turns"]
        gaps = now["highest"] - now["lowest"] + 1 - turns if turns else 0
        return [now["conv"], gaps, *now["faults"][1:], now["illegal"], now["cost"],
                "".join(now["audit"]), now["hash"].hexdigest()]

    def table(rows):
        columns = list(zip(*rows)) if rows else [[] for _ in names]
        kinds = [conv_type, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    for batch in batches:
        conv_type, rows = batch.schema.field(0).type, []
        for conv, turn, role, text, copies, fault, inserted, edit, new_role, tail in zip(
                *[c.to_pylist() for c in batch.columns]):
            if now is None or conv != now["conv"]:
                if now is not None:
                    rows.append(done())
                now = {"conv": conv, "turns": 0, "turn": None, "faults": [0] * 4, "illegal": 0,
                       "cost": 0, "audit": [], "hash": hashlib.sha256(), "said": False,
                       "initial": None}
            if turn is not None and turn != now["turn"]:
                now["turns"] += 1
                now["lowest"] = turn if now["turns"] == 1 else now["lowest"]
                now["highest"] = now["turn"] = turn
            now["faults"][fault] += 1
            now["faults"][BLANK if fault == BLANK else DUPLICATE] += copies - 1
            pair = (now["initial"] or "") + role[:1]
            now["illegal"] += now["initial"] is not None and pair not in ("su", "ua", "au")
            now["illegal"] += copies - 1
            now["initial"] = role[:1]
            cost = {"K": 0, "R": RELABEL, "D": DELETE}[edit] + DELETE * (copies - 1)
            now["cost"] += (cost + INSERT * len(inserted + tail)
                            + CUT_OFF * (fault == TRUNCATED and edit != "D"))
            now["audit"].append("I" * len(inserted) + edit + "D" * (copies - 1) + "I" * len(tail))
            lines = [f"{_ROLE['sua'.index(i) + 1]}:" for i in inserted]
            if edit != "D":
                lines.append(f"{new_role or role}:{text}")
            for line in lines + [f"{_ROLE['sua'.index(i) + 1]}:" for i in tail]:
                now["hash"].update(b"\n" * now["said"] + line.encode())
                now["said"] = True
        yield table(rows)
    if now is not None:
        yield table([done()])


def digest(turns: DataFrame, edits: DataFrame, conv: str = "conv_id") -> DataFrame:
    """A row for each conversation of ``turns``: faults, cost, edits and hash of what is left.

    A conversation's edits are one value and its hash is sequential, so its rows pass through one
    task, one after the other; the task holds the hash and the letters of the edits.
    """
    kind = edits.schema["conv"].dataType.simpleString()
    told = edits.repartition("conv").sortWithinPartitions("conv", "seq").select(
        "conv", "turn", "role", "text", "copies", "fault", "inserted", "edit", "new_role",
        "ending").mapInArrow(_tell, f"conv {kind}, gaps bigint, blank bigint, duplicate bigint, "
                             "truncated bigint, illegal bigint, cost bigint, audit string, "
                             "repaired_sha256 string")
    all_ = turns.select(F.col(conv).alias("c")).distinct()
    zero = [F.coalesce(n, F.lit(0).cast("bigint")).alias(n) for n in
            ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return all_.join(told, F.col("c").eqNullSafe(F.col("conv")), "left").select(
        F.col("c").alias(conv), *zero, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias(
            "repaired_sha256"))
