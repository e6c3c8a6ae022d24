"""Conversation structure repair, by weighted finite-state composition.

A conversation is an input acceptor: a chain of arcs, one for each row, with the initial of its role
and its fault.  An edit transducer keeps, reroles or deletes a row, or inserts one, at a cost.  A
role-grammar acceptor says which roles may follow each other.  The three are composed lazily: the
arcs of a composed state come from the row's symbol and the grammar's state alone, and are made
when a symbol is first met.  The composition has no cycles but those of insertions, which only cost,
so the cheapest edits are a shortest path in the order of the rows, over weights (cost, labels): of
equal costs the path counts whose labels, one for each edit, are least in ASCII.

Labels are compared without their strings.  Two paths to one row that end with an edit of that row
are never prefixes of each other, so a step compares the ranks of the paths that it continues, then
the labels that it adds.  A conversation takes four bytes a row while its path is looked for, and
none of its text: the edits are applied in a second pass, in which they come before the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StringType, StructField, StructType

from barloom.llm.common import stored

#: Characters that are no word's, those that end a sentence, and pairs of roles that may follow each other.
WHITE_SPACE, SENTENCE_ENDS = " \t\n\x0b\x0c\r", ".!?"
LEGAL_PAIRS = ("su", "ua", "au")
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"


@dataclass(frozen=True)
class Grammar:
    """An acceptor of role initials: the arcs of each state, and the states in which it may end."""

    arcs: tuple[Mapping[str, int], ...]
    finals: frozenset[int]


#: (s?(ua)+)?
TURNS = Grammar(({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}), frozenset({0, 3}))


@dataclass(frozen=True)
class Edits:
    """Costs of the edits, and the roles that may be given to a row."""

    keep: int = 0
    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3  # on top, for such a row that stays
    roles: tuple[str, ...] = ("assistant", "user")

    def __post_init__(self) -> None:
        if self.insert <= 0 or min(self.keep, self.rerole, self.delete, self.truncated) < 0:
            raise ValueError("insertions need a cost, and no cost is negative")


@dataclass(frozen=True)
class Move:
    """Some insertions, then an edit of a row: from a state of the grammar to another."""

    start: int
    end: int
    cost: int
    labels: str
    roles: tuple[str | None, ...] = field(default=())  # of each label's row; None: as it is, or deleted


class Composition:
    """Edit transducer and role grammar, with the input's arcs composed when they are met."""

    def __init__(self, grammar: Grammar = TURNS, edits: Edits = Edits()):
        self.grammar, self.edits = grammar, edits
        self.inserts = [self._inserted(q) for q in range(len(grammar.arcs))]
        self.known: dict[tuple[str, str], list[list[Move]]] = {}

    def _inserted(self, start: int) -> list[Move]:
        """The fewest insertions from a state to each state that they reach."""
        found, wave = {start: Move(start, start, 0, "")}, [start]
        while wave:
            following = []
            for q in wave:
                for role in self.edits.roles:
                    end = self.grammar.arcs[q].get(role[0])
                    if end is not None and end not in found:
                        m = found[q]
                        found[end] = Move(start, end, m.cost + self.edits.insert, m.labels + "I", (*m.roles, role))
                        following.append(end)
            wave = following
        return list(found.values())

    def moves(self, initial: str, fault: str) -> list[list[Move]]:
        """The moves over a row with this symbol, by the state that they start from."""
        if (initial, fault) not in self.known:
            self.known[initial, fault] = [[m for i in self.inserts[q] for m in self._edited(i, initial, fault)] for q in range(len(self.inserts))]
        return self.known[initial, fault]

    def _edited(self, m: Move, initial: str, fault: str) -> Iterator[Move]:
        edits, arcs = self.edits, self.grammar.arcs[m.end]
        yield Move(m.start, m.end, m.cost + edits.delete, m.labels + "D", (*m.roles, None))
        if fault in (BLANK, DUPLICATE):
            return
        more = edits.truncated if fault == TRUNCATED else 0
        if initial in arcs:
            yield Move(m.start, arcs[initial], m.cost + edits.keep + more, m.labels + "K", (*m.roles, None))
        for role in edits.roles:
            if role[0] in arcs:
                yield Move(m.start, arcs[role[0]], m.cost + edits.rerole + more, m.labels + "R", (*m.roles, role))


class ShortestPath:
    """The cheapest edits of one conversation, row by row."""

    def __init__(self, composition: Composition):
        self.composition = composition
        n = len(composition.grammar.arcs)
        self.cost: list[int | None] = [0] + [None] * (n - 1)
        self.rank = [0] * n
        self.steps: list[bytearray] = [bytearray() for _ in range(n)]  # the move into each state, for each row
        self.moves: list[Move] = []
        self.numbers: dict[Move, int] = {}

    def _number(self, move: Move) -> int:
        if move not in self.numbers:
            self.numbers[move] = len(self.moves)
            self.moves.append(move)
        return self.numbers[move]

    def add(self, initial: str, fault: str) -> None:
        best: dict[int, tuple[tuple[int, int, str], Move]] = {}
        for cost, rank, moves in zip(self.cost, self.rank, self.composition.moves(initial, fault)):
            if cost is not None:
                for m in moves:
                    key = (cost + m.cost, rank, m.labels)
                    if m.end not in best or key < best[m.end][0]:
                        best[m.end] = (key, m)
        n = len(self.cost)
        self.cost = [best[q][0][0] if q in best else None for q in range(n)]
        for place, q in enumerate(sorted(best, key=lambda q: best[q][0][1:])):
            self.rank[q] = place
        for q in range(n):
            self.steps[q].append(self._number(best[q][1]) if q in best else 0)

    def finish(self) -> tuple[int, str, list[str | None]]:
        """Cost, audit (labels) and the role of each label."""
        ends = [
            ((cost + m.cost, self.rank[q], m.labels), m) for q, cost in enumerate(self.cost) if cost is not None
            for m in self.composition.inserts[q] if m.end in self.composition.grammar.finals
        ]
        (cost, _, _), last = min(ends, key=lambda x: x[0])
        path, q = [last], last.start
        for row in range(len(self.steps[0]) - 1, -1, -1):
            path.append(self.moves[self.steps[q][row]])
            q = path[-1].start
        path.reverse()
        return cost, "".join(m.labels for m in path), [r for m in path for r in m.roles]


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) with faults by crc32(``conv_id:turn``) % 20.

    0 drops the row (it stays with ``dropped`` set, so that no conversation is lost), 1 empties the
    text, 2 takes its ``.!?`` away, 3 repeats the row, 4 makes its role user.  Nulls are a space.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("_kind"))
    hurt = rows.select(
        "conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", SENTENCE_ENDS, "")).otherwise(F.col("text")).alias("text"),
        (F.col("_kind") == 0).alias("dropped"), F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))),
    )
    return hurt.drop("col")


def flagged(rows: DataFrame) -> DataFrame:
    """conv_id, place, turn, role, text, fault, dropped: rows numbered within their conversation.

    Rows go by turn, nulls first; those of one turn by role and text.  One shuffle by conversation
    serves both windows, which stream.
    """
    dropped = F.col("dropped") if "dropped" in rows.columns else F.lit(False)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    dealt = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role"), text("text"), dropped.alias("dropped")).repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "dropped", "role", "text").orderBy("turn")) > 1
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("dropped", "turn", "role", "text", "_again"))
    rest = F.rtrim("text", F.lit(WHITE_SPACE))
    fault = F.when(rest == "", BLANK).when(F.col("_again"), DUPLICATE).when(~F.right(rest, F.lit(1)).isin(*SENTENCE_ENDS), TRUNCATED).otherwise("")
    return dealt.withColumn("_again", again).select("conv_id", place.cast("long").alias("place"), "turn", "role", "text", fault.alias("fault"), "dropped")


COUNTS = ("gaps", BLANK, DUPLICATE, TRUNCATED, "illegal", "cost")


class _Conversation:
    """What the audit of one conversation knows after each of its rows."""

    def __init__(self, conv_id: object, composition: Composition):
        self.conv_id, self.path = conv_id, ShortestPath(composition)
        self.counts = dict.fromkeys(COUNTS, 0)
        self.first = self.last = self.initial = None
        self.turns = 0

    def add(self, turn: int | None, initial: str, fault: str) -> None:
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.last
            self.last = turn
        if fault:
            self.counts[fault] += 1
        self.counts["illegal"] += self.initial is not None and self.initial + initial not in LEGAL_PAIRS
        self.initial = initial
        self.path.add(initial, fault)

    def finish(self) -> dict[str, object]:
        cost, audit, roles = self.path.finish()
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return {"conv_id": self.conv_id, **self.counts, "gaps": gaps, "cost": cost, "audit": audit, "roles": "".join((r or "-")[0] for r in roles)}


def _with_id(kind: DataType, columns: Mapping[str, DataType]) -> StructType:
    return StructType([StructField("conv_id", kind), *(StructField(n, t) for n, t in columns.items())])


def audits(rows: DataFrame, grammar: Grammar = TURNS, edits: Edits = Edits()) -> DataFrame:
    """One row a conversation of ``flagged`` rows: the counts, cost, audit, and ``roles``, the
    initial of the role that each edit gives (``-``: none).  No text is shuffled."""
    kind = rows.schema["conv_id"].dataType
    names = (*COUNTS, "audit", "roles")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        composition, now = Composition(grammar, edits), None
        for batch in batches:
            done = []
            columns = (c.to_pylist() for c in batch.columns)
            for conv_id, turn, initial, fault, dropped in zip(*columns):
                if now is None or now.conv_id != conv_id:
                    done += [now.finish()] if now else []
                    now = _Conversation(conv_id, composition)
                if not dropped:
                    now.add(turn, initial, fault)
            if done:
                yield batch_of(done, batch.schema.field(0).type)
        if now:
            yield batch_of([now.finish()], batch.schema.field(0).type)

    def batch_of(done: list[dict], id_type: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(done, pa.schema([("conv_id", id_type), *((n, pa.int64()) for n in COUNTS), ("audit", pa.string()), ("roles", pa.string())]))

    symbols = rows.select("conv_id", "place", "turn", F.left("role", F.lit(1)).alias("initial"), "fault", "dropped")
    ordered = symbols.repartition("conv_id").sortWithinPartitions("conv_id", "place").drop("place")
    return ordered.mapInArrow(run, _with_id(kind, {n: LongType() if n in COUNTS else StringType() for n in names}))


def _edited(batches: Iterable[pa.RecordBatch], names: Mapping[str, str]) -> Iterator[tuple[object, str | None, str | None, str | None]]:
    """Repaired rows in order: conv_id, edit, role, text.  Before a conversation's own comes one with neither."""
    audit = roles = ""
    at = 0

    def inserted() -> Iterator[tuple]:
        nonlocal at
        while audit[at : at + 1] == "I":
            yield conv_id, "I", names[roles[at]], ""
            at += 1

    for batch in batches:
        for conv_id, place, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if place == 0:
                audit, roles, at = role, text, 0
                yield conv_id, None, None, None
            else:
                if audit[at] != "D":
                    yield conv_id, audit[at], names.get(roles[at], role), text
                at += 1
            yield from inserted()


def _audited(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """The rows of each conversation in order, after a row of place 0 with its audit and roles."""
    heads = audited.select("conv_id", F.lit(0).cast("long").alias("place"), F.col("audit").alias("role"), F.col("roles").alias("text"))
    both = heads.unionByName(rows.filter(~F.col("dropped")).select("conv_id", "place", "role", "text"))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "place")


def repaired(rows: DataFrame, audited: DataFrame, edits: Edits = Edits()) -> DataFrame:
    """conv_id, place (from 1), edit, role, text of the repaired conversations, streamed."""
    names = {r[0]: r for r in edits.roles}
    kind = rows.schema["conv_id"].dataType

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, out = 0, []
        id_type = None

        def types() -> Iterator[pa.RecordBatch]:
            nonlocal id_type
            for batch in batches:
                id_type = batch.schema.field(0).type
                yield batch

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(out, pa.schema([("conv_id", id_type), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))

        for conv_id, edit, role, text in _edited(types(), names):
            place = place + 1 if edit else 0
            if edit:
                out.append({"conv_id": conv_id, "place": place, "edit": edit, "role": role, "text": text})
            if len(out) >= 1000:
                yield flush()
                out = []
        if out:
            yield flush()

    return _audited(rows, audited).mapInArrow(run, _with_id(kind, {"place": LongType(), "edit": StringType(), "role": StringType(), "text": StringType()}))


def digests(rows: DataFrame, audited: DataFrame, edits: Edits = Edits()) -> DataFrame:
    """conv_id, repaired_sha256 of the repaired rows as ``role:text``, joined by newlines."""
    names = {r[0]: r for r in edits.roles}
    kind = rows.schema["conv_id"].dataType

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, any_row, done, id_type = None, False, [], None

        def types() -> Iterator[pa.RecordBatch]:
            nonlocal id_type
            for batch in batches:
                id_type = batch.schema.field(0).type
                yield batch

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(done, pa.schema([("conv_id", id_type), ("repaired_sha256", pa.string())]))

        for conv_id, edit, role, text in _edited(types(), names):
            if edit is None:
                done += [{"conv_id": now[0], "repaired_sha256": now[1].hexdigest()}] if now else []
                now, any_row = (conv_id, hashlib.sha256()), False
                if len(done) >= 1000:
                    yield flush()
                    done = []
            else:
                now[1].update(f"{chr(10) * any_row}{role}:{text}".encode())
                any_row = True
        if now:
            done.append({"conv_id": now[0], "repaired_sha256": now[1].hexdigest()})
            yield flush()

    return _audited(rows, audited).mapInArrow(run, _with_id(kind, {"repaired_sha256": StringType()}))


def repair_report(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, dropped) -> one row a conversation: conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Nulls of role and text are a space; rows without a conv_id are one conversation; rows without a
    turn come first and make no gap.  A role that begins with none of the grammar's initials, or is
    empty, can't be kept.  Rows of one turn go by role and text.  Repeated rows are duplicates.
    ``dropped`` rows, if there is such a column, count for nothing; a conversation of them alone has
    zeros, an empty audit and the digest of nothing.  Texts and conversations may be of any length;
    an audit has a character for each row.  Other columns are ignored; no rows give no rows.

    A conversation's digest is by definition one pass over its rows in order, so one task streams
    them, with the audit of that conversation in memory and nothing else.
    """
    kept = stored(flagged(rows), "flagged")
    audited = stored(audits(kept), "audits")
    told = digests(kept, audited).withColumnRenamed("conv_id", "_id")
    return audited.join(told, F.col("conv_id").eqNullSafe(F.col("_id"))).select("conv_id", *COUNTS, "audit", "repaired_sha256")


def _oracle() -> str:
    """The same in SQL: paths are strings, the cost in seven digits and then the labels."""
    more = lambda path, cost, label: f"(lpad(CAST(CAST({path}[:7] AS INT) + {cost} AS VARCHAR), 7, '0') || {path}[8:] || '{label}')"
    least = lambda *paths: f"least({', '.join(paths)})"
    only = lambda condition, path: f"CASE WHEN {condition} THEN {path} END"
    kept = lambda path, initial: only(f"stays AND initial = '{initial}'", more(path, "extra", "K"))
    rerole = lambda path: only("stays", more(path, "3 + extra", "R"))
    after = {
        "v0": more("e0", 4, "D"), "v1": least(more("e1", 4, "D"), kept("e0", "s")),
        "v2": least(more("e2", 4, "D"), *(f(q) for q in ("e0", "e1", "e3") for f in (lambda p: kept(p, "u"), rerole))), "v3": least(more("e3", 4, "D"), kept("e2", "a"), rerole("e2")),
    }
    closed = {
        "e0": "v0", "e1": "v1", "e2": least("v2", *(more(q, 3, "I") for q in ("v0", "v1", "v3"))), "e3": least("v3", more("v2", 3, "I"), more("v0", 6, "II"), more("v1", 6, "II")),
    }
    columns = lambda d: ", ".join(f"{sql} AS {name}" for name, sql in d.items())
    return f"""
WITH RECURSIVE crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT)) AS k FROM conversations),
kinds AS (SELECT keyed.*, xor(4294967295, list_reduce(k, lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295)) % 20 AS kind FROM keyed, crc_table),
hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text
         FROM (SELECT *, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM kinds WHERE kind <> 0)),
seen AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS rest, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS again FROM hurt),
flagged AS (SELECT conv_id, turn, role, text, role[:1] AS initial, CASE WHEN rest = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN NOT rest[-1:] IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS place FROM seen),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
            count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY place) || initial AS pair FROM flagged) GROUP BY conv_id),
paths AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS place, '0000000' AS v0, CAST(NULL AS VARCHAR) AS v1, CAST(NULL AS VARCHAR) AS v2, CAST(NULL AS VARCHAR) AS v3 FROM conversations
  UNION ALL
  SELECT conv_id, place, {columns(after)} FROM (
    SELECT p.conv_id, f.place, initial, fault NOT IN ('blank', 'duplicate') AS stays, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS extra, {columns(closed)}
    FROM paths p JOIN flagged f ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND f.place = p.place + 1)),
best AS (SELECT conv_id, {least("v0", "v3", more("v2", 3, "I"), more("v0", 6, "II"), more("v1", 6, "II"))} AS path FROM paths QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY place DESC) = 1),
audits AS (SELECT conv_id, CAST(path[:7] AS BIGINT) AS cost, path[8:] AS audit FROM best),
labels AS (SELECT conv_id, pos, audit[pos] AS label, length(replace(audit[:pos], 'I', '')) AS place, length(replace(audit[:pos - 1], 'D', '')) AS before FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS pos FROM audits)),
lines AS (SELECT l.conv_id, pos, label, before, f.role, f.initial, CASE WHEN label = 'I' THEN '' ELSE f.text END AS text FROM labels l LEFT JOIN flagged f ON l.conv_id IS NOT DISTINCT FROM f.conv_id AND l.place = f.place WHERE label <> 'D'),
led AS (SELECT conv_id, max(CASE WHEN before = 0 AND label = 'K' AND initial = 's' THEN 1 ELSE 0 END) AS lead FROM lines GROUP BY conv_id),
joined AS (SELECT x.conv_id, string_agg(CASE WHEN label = 'K' THEN role WHEN (before - lead) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY pos) AS whole FROM lines x JOIN led y ON x.conv_id IS NOT DISTINCT FROM y.conv_id GROUP BY x.conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM audits a LEFT JOIN counted c ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN joined j ON a.conv_id IS NOT DISTINCT FROM j.conv_id
"""


ORACLE = _oracle()
