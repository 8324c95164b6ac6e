"""Conversation repair: cheapest edits by the auction algorithm for shortest paths.

A conversation is a lattice: a layer for each row and, in a layer, a node for each state of the role pattern (nothing yet,
after system, after user, after assistant). Arcs are edits with integer costs: Delete, Insert, Keep, Rerole. The
auction keeps a price for each node, no more than the cost of an arc and the price where it ends, and a path from the
start. At its last node, the path is extended by the arc of least cost and price if that equals the node's price; else
the price is raised to it and the path contracts by one node. Once the path reaches the goal, each arc of each cheapest
path is tight, and as ties take the least initial and prices never fall, the path is the least of them in ASCII order.

Rows are dealt by ranges of (conversation, turn), so that a conversation of any size is spread over tasks, and read in
order without being gathered. A conversation that lies inside a range and has BLOCK_ROWS rows and BLOCK_BYTES bytes at
most is repaired at once. Others are cut into blocks. An auction tells, for each block, the cost and the order of the edits
from each state to each other; blocks are arcs of a coarser lattice, FAN of them of one still coarser, and so on up to
one arc. Then states chosen above go down level by level, and each block is repaired from its state to its state. Blocks of a
conversation stream in order through one task at last, as a digest of the whole text can't be had otherwise.

Results for odd rows: null roles and texts stand for one blank; null turns come first; rows of one turn are
ordered by role and digest of the text; a null conversation id is one conversation; an empty role has no initial,
so such a row can't be kept; repeated rows are repeated; columns besides the four are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spelling import crc32_sql
from .work import kept, quoted, small, table

#: Bounds of a block, blocks or groups of them under one arc, and bytes of text in a range of rows.
BLOCK_ROWS, BLOCK_BYTES, FAN, RANGE_BYTES = 64, 1 << 20, 64, 128 << 20
#: States of the pattern (s?(ua)+)?: nothing yet, after system, after user, after assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: What may follow each state besides system at the begin, and the state that it leads to.
WANTED, LEADS = ("user", "user", "assistant", "user"), (USER, USER, ASSISTANT, USER)
#: Inserts that end the pattern.
CLOSING = (0, 2, 1, 0)
LEGAL = {"su", "ua", "au"}
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
NEVER = 1 << 60
_SPACE = " \t\n\x0b\x0c\r"

RESULT = "conv {id}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
BLOCK = "part int, g int, seq int, turns array<bigint>, roles array<string>, texts array<string>, ties array<string>, faults array<int>"

# ---------------------------------------------------------------- the auction


def _arcs(initial: str, fault: int) -> list[list[tuple[str, int, int]]]:
    """For each state the edits of a row as (initial, cost, how much further on the next node is), least initial first."""
    out = []
    for state in range(4):
        arcs = [("D", 3, 4), ("I", 2, LEADS[state] - state)]
        if fault in (NONE, TRUNCATED):
            more = int(fault == TRUNCATED)
            if initial == "s" and state == NOTHING:
                arcs.append(("K", more, 4 + SYSTEM - state))
            if initial and initial == WANTED[state][0]:
                arcs.append(("K", more, 4 + LEADS[state] - state))
            arcs.append(("R", 2 + more, 4 + LEADS[state] - state))
        out.append(arcs)
    return out


_ROW_ARCS = {(i, f): _arcs(i, f) for i in ("s", "u", "a", "") for f in range(4)}
#: After the last row of a whole conversation: inserts that close the pattern, and the goal, a node beyond.
_CLOSE = [[("", 0, 4)], [("I", 2, USER - SYSTEM)], [("I", 2, ASSISTANT - USER)], [("", 0, 1)]]


def layers_of(roles: list[str], faults: list[int]) -> list[list]:
    return [_ROW_ARCS[r[:1] if r[:1] in ("s", "u", "a") else "", f] for r, f in zip(roles, faults)]


def auction(layers: list[list], source: int, goal: int, prices: list[int]) -> list:
    """The labels of the cheapest path, least in order, from node source to node goal, which it must reach; prices stay for the next source.

    Node 4 * k + q is state q of layer k; layers[k][q] has (label, cost, offset of the next node), least label first.
    """
    path, labels = [source], []
    while (node := path[-1]) != goal:
        best, label, step = NEVER, None, 0
        for a, cost, offset in layers[node >> 2][node & 3] if node >> 2 < len(layers) else ():
            if cost + prices[node + offset] < best:
                best, label, step = cost + prices[node + offset], a, offset
        if prices[node] < best:
            prices[node] = best
            if labels:
                path.pop()
                labels.pop()
        else:
            path.append(node + step)
            labels.append(label)
    return labels


def repair(roles: list[str], faults: list[int]) -> tuple[int, str]:
    """Cost and initials of the cheapest edits of a whole conversation."""
    layers = [*layers_of(roles, faults), _CLOSE]
    prices = [0] * (4 * len(layers) + 4)
    labels = auction(layers, 0, 4 * len(layers), prices)
    return prices[0], "".join(labels)


def between(layers: list[list], source: int, goal: int, prices: list[int] | None = None) -> list:
    """auction() from a state before the first layer to a state after the last one; other states there lead nowhere."""
    return auction(layers, source, 4 * len(layers) + goal, prices or start_prices(len(layers), goal))


def start_prices(n: int, goal: int) -> list[int]:
    """No state leads back to one before it but after user and after assistant to each other: from those that can't lead to goal there is no way."""
    dead = [q > goal and goal < USER for q in range(4)]
    return [NEVER if dead[q] or (k == n and q != goal) else 0 for k in range(n + 1) for q in range(4)]


def reached(layers: list[list], source: int) -> set[int]:
    """States after the last layer that the source leads to."""
    states = {source}
    for arcs in layers:
        todo, after = list(states), set()
        while todo:
            q = todo.pop()
            for _, _, offset in arcs[q]:
                if q + offset >= 4:
                    after.add(q + offset - 4)
                elif q + offset not in states:
                    states.add(q + offset)
                    todo.append(q + offset)
        states = after
    return states


def crossings(layers: list[list]) -> tuple[list[int], list[int]]:
    """For each pair of states, 4 * before + after: the cost between them, -1 if there is no way, and the place of its edits in the order of those from the same state."""
    costs, found = [-1] * 16, [[] for _ in range(4)]
    ways = [reached(layers, q) for q in range(4)]
    for goal in range(4):
        prices = start_prices(len(layers), goal)
        for q in range(4):
            if goal in ways[q]:
                labels = between(layers, q, goal, prices)
                costs[4 * q + goal] = prices[q]
                found[q].append((labels, goal))
    order = [0] * 16
    for q in range(4):
        for place, (_, goal) in enumerate(sorted(found[q])):
            order[4 * q + goal] = place
    return costs, order


def coarse_layer(costs: list[int], order: list[int]) -> list[list]:
    """A block as a layer: its ways from each state, labelled by their order."""
    return [sorted((order[4 * q + r], costs[4 * q + r], 4 + r - q) for r in range(4) if costs[4 * q + r] >= 0) for q in range(4)]


# ---------------------------------------------------------------- rows of a conversation


def repaired_lines(roles: list[str], texts: list[str], audit: str, state: int = NOTHING) -> list[str]:
    """The lines role:text that the edits leave, from a state on."""
    lines, k = [], 0
    for edit in audit:
        if edit == "I":
            lines.append(f"{WANTED[state]}:")
            state = LEADS[state]
            continue
        if edit == "R":
            lines.append(f"{WANTED[state]}:{texts[k]}")
            state = LEADS[state]
        elif edit == "K":
            lines.append(f"{roles[k]}:{texts[k]}")
            state = SYSTEM if roles[k][0] == "s" else LEADS[state]
        k += 1
    return lines


def with_duplicates(roles: list[str], ties: list[str], faults: list[int], earlier: set[tuple[str, str]] = frozenset()) -> list[int]:
    """The first fault of each row; earlier: what was seen before these rows."""
    seen, out = set(earlier), []
    for role, tie, fault in zip(roles, ties, faults):
        out.append(DUPLICATE if fault != BLANK and (role, tie) in seen else fault)
        seen.add((role, tie))
    return out


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def _gaps(turns: list[int]) -> int:
    return max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0


def _result(conv, turns: list, roles: list[str], texts: list[str], ties: list[str], faults: list[int]) -> tuple:
    """The result of a whole conversation."""
    faults = with_duplicates(roles, ties, faults)
    cost, audit = repair(roles, faults)
    digest = hashlib.sha256("\n".join(repaired_lines(roles, texts, audit)).encode()).hexdigest()
    return conv, _gaps([t for t in turns if t is not None]), faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), _illegal([r[:1] for r in roles]), cost, audit, digest


def _read(batches: Iterator[pa.RecordBatch], schema: pa.Schema, block_rows: int) -> Iterator[pa.RecordBatch]:
    """Results of the conversations that lie inside this range, and blocks of all others."""
    part, n_result = TaskContext.get().partitionId(), len(schema) - 8
    out: list[tuple] = []
    rows: list[tuple] = []
    g, seq, size, conv = -1, 0, 0, None

    def block() -> tuple:
        live = [r[1:] for r in rows if not r[0]]
        return (conv, *[None] * (n_result - 1), part, g, seq, *[list(c) for c in (zip(*live) if live else [()] * 5)])

    def flushed(force: bool) -> pa.RecordBatch | None:
        nonlocal out
        if out and (force or len(out) >= 2048):
            made, out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema), []
            return made
        return None

    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            for own, gone, *row in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns)):
                if g < 0 or own != conv:
                    if g == 0 or g > 0 and seq:
                        out.append(block())
                    elif g > 0:
                        live = [r[1:] for r in rows if not r[0]]
                        out.append((*_result(conv, *[list(c) for c in (zip(*live) if live else [()] * 5)]), *[None] * 8))
                    conv, g, seq, rows, size = own, g + 1, 0, [], 0
                elif len(rows) >= block_rows or size > BLOCK_BYTES:
                    out.append(block())
                    seq, rows, size = seq + 1, [], 0
                rows.append((gone, *row))
                size += len(row[2])
            if made := flushed(size > BLOCK_BYTES):
                yield made
    if g >= 0:
        out.append(block())
    if made := flushed(True):
        yield made


# ---------------------------------------------------------------- blocks of long conversations

_CROSSED = "chain bigint, ordinal bigint, costs array<int>, places array<int>"
_STATES = "chain bigint, ordinal bigint, entry int, exit int"


def _faults(row: dict) -> list[int]:
    return with_duplicates(row["roles"], row["ties"], row["faults"], {(r["role"], r["tie"]) for r in row["repeated"] or ()})


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield from batch.slice(at, 1).to_pylist()


def _listed(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _block_crossings(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for row in _rows_of(batches):
        yield _listed([(row["chain"], row["ordinal"], *crossings(layers_of(row["roles"], _faults(row))))], schema)


def _group_crossings(rows: pa.Table, schema: pa.Schema, fan: int) -> pa.Table:
    parts = rows.sort_by("ordinal").to_pylist()
    found = crossings([coarse_layer(r["costs"], r["places"]) for r in parts])
    return pa.Table.from_batches([_listed([(parts[0]["chain"], parts[0]["ordinal"] // fan, *found)], schema)])


def _top_states(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for row in _rows_of(batches):
        ends = [(row["costs"][q] + 2 * CLOSING[q], row["places"][q], q) for q in range(4) if row["costs"][q] >= 0]
        yield _listed([(row["chain"], row["ordinal"], NOTHING, min(ends)[2])], schema)


def _inner_states(rows: pa.Table, schema: pa.Schema) -> pa.Table:
    """States before and after each block of a group, from those of the group."""
    parts = rows.sort_by("ordinal").to_pylist()
    layers = [coarse_layer(r["costs"], r["places"]) for r in parts]
    state, out = parts[0]["entry"], []
    for part, layer, label in zip(parts, layers, between(layers, state, parts[0]["exit"])):
        after = state + next(offset for place, _, offset in layer[state] if place == label) - 4
        out.append((part["chain"], part["ordinal"], state, after))
        state = after
    return pa.Table.from_batches([_listed(out, schema)])


_PART = "chain bigint, ordinal bigint, conv {id}, n_turns bigint, first_turn bigint, last_turn bigint, first_initial string, last_initial string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired string"


def _block_repairs(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for row in _rows_of(batches):
        roles, faults, turns = row["roles"], _faults(row), [t for t in row["turns"] if t is not None]
        layers, prices = layers_of(roles, faults), start_prices(len(roles), row["exit"])
        audit, closing = "".join(between(layers, row["entry"], row["exit"], prices)), CLOSING[row["exit"]] if row["ordinal"] == row["total"] - 1 else 0
        cost, audit = prices[row["entry"]] + 2 * closing, audit + "I" * closing
        lines, initials = repaired_lines(roles, row["texts"], audit, row["entry"]), [r[:1] for r in roles]
        yield _listed([(row["chain"], row["ordinal"], row["conv"], len(set(turns)), min(turns, default=None), max(turns, default=None), initials[0] if roles else None, initials[-1] if roles else None, faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), _illegal(initials), cost, audit, "\n".join(lines) if lines else None)], schema)


def _assembled(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Results of conversations from their blocks, which come in order; no block is held."""
    chain = now = None
    for row in _rows_of(batches):
        if row["chain"] != chain:
            if now:
                yield _ended(now, schema)
            chain, now = row["chain"], {"conv": row["conv"], "first": None, "last": None, "n_turns": 0, "initial": None, "sums": [0] * 5, "audit": [], "digest": hashlib.sha256(), "any": False}
        if row["first_turn"] is not None:
            now["first"] = row["first_turn"] if now["first"] is None else now["first"]
            now["n_turns"] += row["n_turns"] - (row["first_turn"] == now["last"])
            now["last"] = row["last_turn"]
        sums = [row["blank"], row["duplicate"], row["truncated"], row["illegal"], row["cost"]]
        if row["first_initial"] is not None:
            sums[3] += now["initial"] is not None and now["initial"] + row["first_initial"] not in LEGAL
            now["initial"] = row["last_initial"]
        now["sums"] = [a + b for a, b in zip(now["sums"], sums)]
        now["audit"].append(row["audit"])
        if row["repaired"] is not None:
            now["digest"].update((b"\n" if now["any"] else b"") + row["repaired"].encode())
            now["any"] = True
    if now:
        yield _ended(now, schema)


def _ended(now: dict, schema: pa.Schema) -> pa.RecordBatch:
    gaps = 0 if now["first"] is None else now["last"] - now["first"] + 1 - now["n_turns"]
    return _listed([(now["conv"], gaps, *now["sums"], "".join(now["audit"]), now["digest"].hexdigest())], schema)


def _long_conversations(blocks: DataFrame, kind: str, fan: int) -> DataFrame:
    """Results of the conversations that lie in blocks (conv and the columns of BLOCK)."""
    spark = blocks.sparkSession
    schema = lambda ddl: spark.createDataFrame([], ddl).toArrow().schema
    crossed, states = schema(_CROSSED), schema(_STATES)
    # A row for each conversation and range that it has blocks in.
    own = Window.partitionBy("conv")
    number = F.shiftleft(F.col("part").cast("bigint"), 32) + F.col("g")
    spans = blocks.groupBy("conv", "part", "g").agg(F.count("*").alias("n"))
    spans = spans.select("part", "g", F.min(number).over(own).alias("chain"), F.sum("n").over(own).alias("total"), (F.sum("n").over(own.orderBy("part")) - F.col("n")).alias("before"))
    blocks = blocks.join(small(kept(spans, "spans")), ["part", "g"]).withColumn("ordinal", F.col("before") + F.col("seq")).drop("part", "g", "seq", "before")
    # Rows that stood in an earlier block.
    said = F.array_distinct(F.arrays_zip(F.col("roles").alias("role"), F.col("ties").alias("tie")))
    said = blocks.where("total > 1").select("chain", "ordinal", F.explode(said).alias("said"))
    first = said.groupBy("chain", "said").agg(F.min("ordinal").alias("first"), F.count("*").alias("n")).where("n > 1").select("chain", "said", "first")
    again = said.join(small(kept(first, "said-again")), ["chain", "said"]).where("ordinal > first")
    blocks = blocks.join(again.groupBy("chain", "ordinal").agg(F.collect_list("said").alias("repeated")), ["chain", "ordinal"], "left")
    blocks = kept(blocks, "blocks")
    levels = [kept(blocks.select("chain", "ordinal", "roles", "ties", "faults", "repeated").mapInArrow(partial(_block_crossings, schema=crossed), _CROSSED), "crossings")]
    while (levels[-1].agg(F.max("ordinal")).first()[0] or 0) > 0:
        grouped = levels[-1].groupBy("chain", F.floor(F.col("ordinal") / fan).alias("up"))
        levels.append(kept(grouped.applyInArrow(lambda rows: _group_crossings(rows, crossed, fan), _CROSSED), "crossings"))
    chosen = levels[-1].mapInArrow(partial(_top_states, schema=states), _STATES)
    for level in reversed(levels[:-1]):
        above = kept(chosen, "states").withColumnRenamed("ordinal", "up")
        inner = level.withColumn("up", F.floor(F.col("ordinal") / fan)).join(above, ["chain", "up"])
        chosen = inner.groupBy("chain", "up").applyInArrow(lambda rows: _inner_states(rows, states), _STATES)
    parts = blocks.join(chosen, ["chain", "ordinal"]).mapInArrow(partial(_block_repairs, schema=schema(_PART.format(id=kind))), _PART.format(id=kind))
    ordered = parts.repartition("chain").sortWithinPartitions("chain", "ordinal")
    return ordered.mapInArrow(partial(_assembled, schema=schema(RESULT.format(id=kind))), RESULT.format(id=kind))


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, gone, turn, role, text): rows with the faults that a checksum of conversation and turn chooses; gone rows stay, marked."""
    of = lambda c: F.coalesce(F.col(quoted(c)).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(of(conv), F.lit(":"), of(turn)).cast("binary")), F.lit(20))
    changed = rows.select(F.col(quoted(conv)).alias("conv"), F.col(quoted(turn)).cast("bigint").alias("turn"), of(role).alias("role"), of(text).alias("text"), kind.alias("kind"))
    texts = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return changed.select("conv", (F.col("kind") == 0).alias("gone"), "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), texts.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def repaired(rows: DataFrame, range_bytes: int = RANGE_BYTES, ranges: int | None = None, block_rows: int = BLOCK_ROWS, fan: int = FAN) -> DataFrame:
    """One row (columns of RESULT) for each conversation of rows (conv, gone, turn, role, text without nulls in gone, role and text); gone rows only name their conversation."""
    spark = rows.sparkSession
    kind = rows.schema["conv"].dataType.simpleString()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // range_bytes))
    said = F.rtrim("text", F.lit(_SPACE))
    fault = F.when(said == "", BLANK).when(F.right(said, F.lit(1)).isin(".", "!", "?"), NONE).otherwise(TRUNCATED)
    rows = rows.select("conv", "gone", "turn", "role", "text", F.md5("text").alias("tie"), fault.alias("fault"))
    ordered = rows.repartitionByRange(ranges, "conv", "turn", "role", "tie").sortWithinPartitions("conv", "turn", "role", "tie")
    both = RESULT.format(id=kind) + ", " + BLOCK
    read = kept(ordered.mapInArrow(partial(_read, schema=spark.createDataFrame([], both).toArrow().schema, block_rows=block_rows), both), "conversations")
    names = [f.name for f in spark.createDataFrame([], RESULT.format(id=kind)).schema]
    blocks = read.where("part is not null").select("conv", *[c for c in read.columns if c not in names])
    return read.where("part is null").select(*names).unionByName(_long_conversations(blocks, kind, fan))


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return repaired(damaged(table(spark, sf_dir, "conversations"))).withColumnRenamed("conv", "conv_id")


_KEY = "list_transform(string_split(concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')), ''), lambda x: ascii(x)::UBIGINT)"
_WHITE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP13_SQL = f"""
WITH RECURSIVE h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql(_KEY)}::BIGINT % 20 AS h FROM conversations),
d AS (SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE h WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE h <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS k, rtrim(text, {_WHITE}) AS said FROM d),
f AS (SELECT *, CASE WHEN said = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'd' WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
  left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM o),
c AS (SELECT conv_id, count(f.k) AS n, coalesce(max(f.turn) - min(f.turn) + 1 - count(DISTINCT f.turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
  count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before || i NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT DISTINCT conv_id AS id FROM conversations) a LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM a.id GROUP BY a.id, conv_id),
s(q, r, c, a, l) AS (VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 2, 'I', ['user:']), (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 2, 2, 'I', ['user:']),
  (1, 3, 4, 'II', ['user:', 'assistant:']), (2, 3, 2, 'I', ['assistant:']), (3, 2, 2, 'I', ['user:'])),
e(q, r, i, c, a, whom) AS (SELECT q, q, NULL::VARCHAR, 3, 'D', NULL::VARCHAR FROM s WHERE a = '' UNION ALL SELECT q, r, CASE r WHEN 3 THEN 'a' ELSE 'u' END, 0, 'K', NULL::VARCHAR FROM s WHERE a = 'I' UNION ALL SELECT 0, 1, 's', 0, 'K', NULL::VARCHAR
  UNION ALL SELECT q, r, NULL::VARCHAR, 2, 'R', l[1] FROM s WHERE a = 'I'),
w(conv_id, k, q, cost, audit, lines) AS (SELECT DISTINCT conv_id, 0::BIGINT, 0, 0, '', []::VARCHAR[] FROM conversations UNION ALL
  SELECT conv_id, k, q, cost, audit, lines FROM (
    SELECT w.conv_id, f.k, e.r AS q, w.cost + s.c + e.c + CASE WHEN e.a <> 'D' AND fault = 't' THEN 1 ELSE 0 END AS cost, audit || s.a || e.a AS audit,
      list_concat(lines, s.l, CASE e.a WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text] ELSE [whom || text] END) AS lines
    FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.k = w.k + 1 JOIN s ON s.q = w.q JOIN e ON e.q = s.r AND (e.a = 'D' OR fault NOT IN ('b', 'd')) AND (e.i IS NULL OR e.i = f.i))
  QUALIFY row_number() OVER (PARTITION BY conv_id, q ORDER BY cost, audit) = 1),
z AS (SELECT c.conv_id, arg_min((cost + s.c, audit || s.a, list_concat(lines, s.l)), (cost + s.c, audit || s.a)) AS best FROM c JOIN w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.k = c.n JOIN s ON s.q = w.q AND s.r IN (0, 3) GROUP BY 1)
SELECT c.conv_id, gaps, blank, duplicate, truncated, illegal, best[1]::BIGINT AS cost, best[2] AS audit, sha256(array_to_string(best[3], chr(10))) AS repaired_sha256
FROM c JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id
"""
