"""Repair of conversations: the cheapest edits that give each the roles ``(system? (user assistant)+)?``.

Spark finds each turn's fault (blank, a repetition, truncated) and writes a conversation down as one symbol per
turn, in segments of SPAN turns. In batches of segments a recursive query of DuckDB advances one turn for all of them
and keeps the minimum cost, and the least audit of that cost, for each state of the grammar; a second one advances
one segment for all conversations of a hash partition. A long conversation is thus many segments in many
tasks, and only its audit, one letter an edit, comes together. Repaired turns are made while rows stream by, sorted by conversation.

Edits: K keeps a turn (0), R gives it the role that must come (3), D deletes it (4; what blank and repeated turns need),
I inserts an empty turn (3). A truncated turn that stays adds 3. No audit is the beginning of another of equal cost, since inserts
cost, so the least audit of a state begins the least audit of the whole.

Null roles and texts are read as one space, a null conversation is one of its own, null turns come first.
Turns of one number are ordered by role and by a digest of the text, and stay in one segment; equal rows are
counted, not collected. Texts of any length are read whole, row by row. An empty table gives an empty table. Other columns,
whatever their names, aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_batches, quoted

#: Turn numbers of a segment.
SPAN = 512
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing yet, after the system's turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: A turn's symbol: the initial of its role, in capitals if truncated, x for other roles; d for one that must go.
MUST_GO = "d"
SPACE = " \t\n\x0b\x0c\r"
EMPTY = hashlib.sha256(b"").hexdigest()
ROLES = {USER: "user", ASSISTANT: "assistant"}


def after(state: int, initial: str) -> int | None:
    """The state after a turn of that initial, if it may come."""
    if initial == "s" and state == START:
        return SYSTEM
    if initial == "u" and state != USER:
        return USER
    return ASSISTANT if initial == "a" and state == USER else None


def due(state: int) -> int:
    """The state after the turn that an insertion or a new role makes."""
    return ASSISTANT if state == USER else USER


def _inserted(state: int) -> Iterator[tuple[int, int, str]]:
    """(state, cost, edits) after up to two insertions; more come back to a state that was there before."""
    cost, edits = 0, ""
    for _ in range(3):
        yield state, cost, edits
        state, cost, edits = due(state), cost + INSERT, edits + "I"


def moves() -> list[tuple[int, str, int, str, int]]:
    """(state, symbol, cost, edits, next state) for a turn and what is inserted before it."""
    out = []
    for state in range(4):
        for symbol in "suaxSUAX" + MUST_GO:
            for at, cost, edits in _inserted(state):
                out.append((state, symbol, cost + DELETE, edits + "D", at))
                if symbol != MUST_GO:
                    more = TRUNCATED if symbol.isupper() else 0
                    out.append((state, symbol, cost + REROLE + more, edits + "R", due(at)))
                    if (kept := after(at, symbol.lower())) is not None:
                        out.append((state, symbol, cost + KEEP + more, edits + "K", kept))
    return out


def closings() -> list[tuple[int, int, str]]:
    """(state, cost, edits) of ends that are allowed."""
    return [(state, cost, edits) for state in range(4) for at, cost, edits in _inserted(state) if at in (START, ASSISTANT)]


# -- faults --------------------------------------------------------------------------------------------------------


def read(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id``, ``turn``, ``role`` and ``text``, without nulls in the last two."""
    space = F.lit(" ")
    return conversations.select(quoted(conv_id).alias("conv_id"), quoted(turn).cast("long").alias("turn"), F.coalesce(quoted(role).cast("string"), space).alias("role"), F.coalesce(quoted(text).cast("string"), space).alias("text"))


def damaged(rows: DataFrame) -> DataFrame:
    """What ``read`` gives, damaged by a checksum of conversation and turn: dropped, emptied, without stops, twice, or a user's."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    copies = F.when(kind == 0, F.array().cast("array<int>")).when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def _digest() -> Column:
    return F.unhex(F.sha2("text", 256))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def segments(rows: DataFrame) -> DataFrame:
    """(conv_id, segment, symbols, initials, counts ..): the turns of each segment as symbols, in order.

    The first turn of a role and text is a minimum over the conversation, joined back, so that a text that fills a conversation is no
    task's burden.
    """
    shown = F.rtrim(F.col("text"), F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    narrow = rows.select("conv_id", "turn", "role", _digest().alias("content"), F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"), shown == "", ~F.substring(shown, -1, 1).isin(".", "!", "?")).toDF("conv_id", "turn", "role", "content", "initial", "blank", "cut")
    grouped = narrow.groupBy("conv_id", "turn", "role", "content").agg(F.count("*").alias("n"), F.max("initial").alias("initial"), F.max("blank").alias("blank"), F.max("cut").alias("cut"))
    firsts = grouped.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("content").alias("t")).agg(F.min(F.struct("turn")).alias("first"))
    known = grouped.join(firsts, _same("conv_id", "c") & (F.col("role") == F.col("r")) & (F.col("content") == F.col("t")))
    new = F.col("turn").eqNullSafe(F.col("first.turn"))
    one = F.when(F.col("blank") | ~new, MUST_GO).when(F.col("cut"), F.upper("initial")).otherwise(F.col("initial"))
    known = known.select("conv_id", F.floor(F.col("turn") / SPAN).alias("segment"), "turn", "role", "content", "n", "initial", one.alias("symbol"), "blank", (~F.col("blank") & new).alias("own"), (~F.col("blank") & new & F.col("cut")).alias("truncated"))
    counts = [F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"), F.sum(F.when(F.col("blank"), 0).otherwise(F.col("n") - F.col("own").cast("long"))).alias("duplicate"), F.sum(F.col("truncated").cast("long")).alias("truncated")]
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "content", "n", "initial", "symbol")))
    out = known.groupBy("conv_id", "segment").agg(*counts, F.min("turn").alias("least"), F.max("turn").alias("most"), F.count_distinct("turn").alias("turns"), turns.alias("x"))
    n = lambda x: x["n"].cast("int")
    symbols = F.flatten(F.transform("x", lambda x: F.concat(F.array(x["symbol"]), F.array_repeat(F.lit(MUST_GO), n(x) - 1))))
    initials = F.flatten(F.transform("x", lambda x: F.array_repeat(x["initial"], n(x))))
    return out.select("conv_id", "segment", "blank", "duplicate", "truncated", "least", "most", "turns", F.array_join(symbols, "").alias("symbols"), initials.alias("initials")).withColumn("illegal", _illegal(F.col("initials"))).withColumn("ends", F.array(F.element_at("initials", 1), F.element_at("initials", -1))).drop("initials")


def _illegal(initials: Column) -> Column:
    """Adjacent pairs that the grammar doesn't allow."""
    n = F.size(initials)
    pairs = F.zip_with(F.slice(initials, 1, F.greatest(n - 1, F.lit(0))), F.slice(initials, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, b))
    return F.size(F.filter(pairs, lambda x: ~x.isin("su", "ua", "au"))).cast("long")


# -- the cheapest edits, in DuckDB ---------------------------------------------------------------------------------

#: One recursion consumes one turn of every segment, from each state that it can begin in.
TURNS = """
WITH RECURSIVE walk(id, began, state, n, best) USING KEY (id, began, state) AS (
  SELECT id, began, began, 0, {'cost': 0, 'audit': ''} FROM segments, range(4) s(began)
  UNION
  SELECT w.id, w.began, m.next, w.n + 1, min({'cost': w.best.cost + m.cost, 'audit': w.best.audit || m.edits})
  FROM walk w JOIN segments g USING (id) JOIN moves m ON m.state = w.state AND m.symbol = substr(g.symbols, w.n + 1, 1)
  GROUP BY w.id, w.began, m.next, w.n + 1)
SELECT id, list({'began': CAST(began AS INTEGER), 'state': CAST(state AS INTEGER), 'cost': CAST(best.cost AS BIGINT), 'audit': best.audit}) AS walks
FROM walk JOIN segments USING (id) WHERE n = length(symbols) GROUP BY id ORDER BY id
"""

#: One recursion consumes one segment of every conversation.
SEGMENTS = """
WITH RECURSIVE numbered AS (SELECT id, unnest(range(1, len(walks) + 1)) AS n, unnest(walks) AS walks FROM conversations),
steps AS (SELECT id, n, unnest(walks) AS step FROM numbered),
walk(id, state, n, best) USING KEY (id, state) AS (
  SELECT id, 0, CAST(0 AS BIGINT), {'cost': CAST(0 AS BIGINT), 'audit': ''} FROM conversations
  UNION
  SELECT w.id, s.step.state, w.n + 1, min({'cost': w.best.cost + s.step.cost, 'audit': w.best.audit || s.step.audit})
  FROM walk w JOIN steps s ON s.id = w.id AND s.n = w.n + 1 AND s.step.began = w.state
  GROUP BY w.id, s.step.state, w.n + 1),
ended AS (SELECT id, min({'cost': w.best.cost + e.cost, 'audit': w.best.audit || e.edits}) AS best
  FROM walk w JOIN conversations c USING (id) JOIN closings e USING (state) WHERE w.n = len(c.walks) GROUP BY id)
SELECT id, CAST(best.cost AS BIGINT) AS cost, best.audit AS audit FROM ended ORDER BY id
"""
WALKS = "array<struct<began:int,state:int,cost:long,audit:string>>"


def _asked(batches: Iterator[pa.RecordBatch], view: str, sql: str, column: str) -> Iterator[pa.RecordBatch]:
    """Each batch with what ``sql`` says of its ``column``; batches are bounded, so is what DuckDB holds."""
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
    con.execute("CREATE TABLE moves(state INTEGER, symbol VARCHAR, cost INTEGER, edits VARCHAR, next INTEGER)")
    con.executemany("INSERT INTO moves VALUES (?, ?, ?, ?, ?)", moves())
    con.execute("CREATE TABLE closings(state INTEGER, cost INTEGER, edits VARCHAR)")
    con.executemany("INSERT INTO closings VALUES (?, ?, ?)", closings())
    for batch in batches:
        if not batch.num_rows:
            continue
        con.register("given", pa.table({"id": pa.array(range(batch.num_rows), pa.int32()), column: batch.column(column)}))
        con.execute(f"CREATE OR REPLACE TABLE {view} AS SELECT * FROM given")
        con.unregister("given")
        said = con.sql(sql).to_arrow_table().combine_chunks()
        if said.num_rows != batch.num_rows:
            raise RuntimeError("a conversation without an end")
        rest = [c for c in batch.schema.names if c != column]
        names = [c for c in said.column_names if c != "id"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *(said.column(c).combine_chunks() for c in names)], [*rest, *names])
    con.close()


def plans(rows: DataFrame) -> DataFrame:
    """One row per conversation that has rows: gaps, blank, duplicate, truncated, illegal, cost, audit."""
    cells = segments(rows)
    kind = cells.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "segment", "blank", "duplicate", "truncated", "least", "most", "turns", "illegal", "ends"]
    walked = map_batches(cells.select(*names, "symbols"), lambda batches: _asked(batches, "segments", TURNS, "symbols"), f"conv_id {kind}, segment long, blank long, duplicate long, truncated long, least long, most long, turns long, illegal long, ends array<string>, walks {WALKS}")
    joined = walked.groupBy("conv_id").agg(
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "turns")),
        F.min("least").alias("least"),
        F.max("most").alias("most"),
        F.array_sort(F.collect_list(F.struct("segment", "ends", "walks"))).alias("x"),
    )
    between = _illegal(F.flatten(F.col("x.ends"))) - F.aggregate(F.col("x.ends"), F.lit(0).cast("long"), lambda total, e: total + _illegal(e))
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0))
    whole = joined.select("conv_id", gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated", (F.col("illegal") + between).alias("illegal"), F.col("x.walks").alias("walks"))
    return map_batches(whole, lambda batches: _asked(batches, "conversations", SEGMENTS, "walks"), f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


# -- repaired turns ------------------------------------------------------------------------------------------------


def repaired(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the turns after the edits of ``planned``, each conversation's in order and together in a partition.

    Rows are sorted by conversation behind their audit and stream by; a task holds a batch.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    nothing = lambda t, name: F.lit(None).cast(t).alias(name)
    heads = planned.select("conv_id", "audit", nothing("long", "turn"), nothing("string", "role"), nothing("binary", "content"), nothing("string", "text"))
    both = heads.unionByName(rows.select("conv_id", nothing("string", "audit"), "turn", "role", _digest().alias("content"), "text"))
    order = [F.col("conv_id").asc(), F.col("audit").isNull().asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("content").asc()]
    streamed = both.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "audit", "role", "text")
    return map_batches(streamed, _edited, f"conv_id {kind}, place long, edit string, role string, text string")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, audit, at, state, place = None, "", 0, START, 0
    names = ["conv_id", "place", "edit", "role", "text"]
    for batch in batches:
        kind, out = batch.schema.field("conv_id").type, []

        def inserted() -> None:
            nonlocal at, state, place
            while at < len(audit) and audit[at] == "I":
                state = due(state)
                out.append((conv, place, "I", ROLES[state], ""))  # noqa: B023
                at, place = at + 1, place + 1

        for own, plan, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text")), strict=True):
            if plan is not None:
                inserted()
                conv, audit, at, state, place = own, plan, 0, START, 0
                continue
            inserted()
            edit, at = audit[at], at + 1
            if edit == "D":
                continue
            if edit == "R":
                state = due(state)
                role = ROLES[state]
            else:
                state = after(state, role[:1])
            out.append((own, place, edit, role, text))
            place += 1
        if out:
            yield _batch(out, names, kind)
    rest = []
    while at < len(audit):
        state = due(state)
        rest.append((conv, place, audit[at], ROLES[state], ""))
        at, place = at + 1, place + 1
    if rest:
        yield _batch(rest, names, kind)


def _batch(rows: list[tuple], names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    types = [kind, pa.int64(), pa.string(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of what ``repaired`` gives, straight from it."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest = None, None
        for batch in batches:
            done, t = [], batch.schema.field("conv_id").type
            for own, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text")), strict=True):
                if place == 0:
                    if digest:
                        done.append((conv, digest.hexdigest()))
                    conv, digest = own, hashlib.sha256()
                digest.update(("\n" * bool(place) + f"{role}:{text}").encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], t), pa.array([d for _, d in done])], ["conv_id", "repaired_sha256"])
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([conv], t), pa.array([digest.hexdigest()])], ["conv_id", "repaired_sha256"])

    return turns.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per conversation of ``conversations``, of which ``rows`` are what is left after damage."""
    planned = cut(plans(rows))
    ids = conversations.select("conv_id").distinct()
    mine = planned.withColumnRenamed("conv_id", "c")
    made = digests(repaired(rows, planned)).withColumnRenamed("conv_id", "d")
    none = lambda name: F.coalesce(F.col(name), F.lit(0).cast("long")).alias(name)
    joined = ids.join(mine, _same("conv_id", "c"), "left").join(made, _same("conv_id", "d"), "left")
    return joined.select("conv_id", *(none(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY)).alias("repaired_sha256"))


#: Damage by a bitwise CRC-32, and the cheapest edits turn by turn over whole conversations.
SQL = r"""
WITH RECURSIVE plain AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  list_transform(string_split(concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')), ''), lambda c: CAST(ord(c) AS BIGINT)) AS bytes FROM conversations),
summed AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda h, b: list_reduce([xor(h, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS kind FROM plain),
rows_ AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM summed, range(2) r(i) WHERE i < CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END),
placed AS (SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, row_number() OVER w AS n,
  lag(role[1]) OVER w || role[1] AS pair FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text))),
faults AS (SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY n) > 1 AS again, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS unended FROM placed),
turns AS (SELECT *, blank OR again AS must, unended AND NOT blank AND NOT again AS truncated FROM faults),
states(q) AS (VALUES (''), ('s'), ('u'), ('a')),
ins AS (SELECT q, q AS q2, 0 AS cost, '' AS edits FROM states UNION ALL SELECT q, CASE q WHEN 'u' THEN 'a' ELSE 'u' END, 3, 'I' FROM states UNION ALL SELECT q, CASE q WHEN 'u' THEN 'u' ELSE 'a' END, 6, 'II' FROM states),
walk(c, n, q, best) AS (
  SELECT DISTINCT c, CAST(0 AS BIGINT), '', {'cost': 0, 'audit': ''} FROM turns
  UNION ALL
  SELECT c, n, q, min(best) FROM (
    SELECT t.c, t.n, e.edit, CASE e.edit WHEN 'D' THEN i.q2 WHEN 'K' THEN t.role[1] WHEN 'R' THEN CASE i.q2 WHEN 'u' THEN 'a' ELSE 'u' END END AS q,
      {'cost': w.best.cost + i.cost + CASE e.edit WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN t.truncated AND e.edit <> 'D' THEN 3 ELSE 0 END, 'audit': concat(w.best.audit, i.edits, e.edit)} AS best
    FROM walk w JOIN turns t ON t.c = w.c AND t.n = w.n + 1 JOIN ins i ON i.q = w.q, (VALUES ('D'), ('K'), ('R')) e(edit)
    WHERE e.edit = 'D' OR (NOT t.must AND (e.edit = 'R' OR (t.role[1] = 's' AND i.q2 = '') OR (t.role[1] = 'u' AND i.q2 <> 'u') OR (t.role[1] = 'a' AND i.q2 = 'u')))) GROUP BY c, n, q),
counted AS (SELECT conv_id, c, max(n) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (truncated) AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, list(role ORDER BY n) AS roles, list(text ORDER BY n) AS texts FROM turns GROUP BY conv_id, c),
ended AS (SELECT k.*, (SELECT min({'cost': w.best.cost + i.cost, 'audit': w.best.audit || i.edits}) FROM walk w JOIN ins i ON i.q = w.q WHERE w.c = k.c AND w.n = k.n AND i.q2 IN ('', 'a')) AS best FROM counted k),
letters AS (SELECT c, i, best.audit[i] AS edit, i - length(replace(substr(best.audit, 1, i), 'I', '')) AS inserted, roles, texts FROM ended, LATERAL (SELECT unnest(range(1, length(best.audit) + 1)) AS i)),
stay AS (SELECT c, i, edit, row_number() OVER (PARTITION BY c ORDER BY i) AS place, roles[i - inserted] AS role, texts[i - inserted] AS text, count(*) FILTER (edit = 'K' AND roles[i - inserted][1] = 's') OVER (PARTITION BY c ORDER BY i) AS system FROM letters WHERE edit <> 'D'),
lines AS (SELECT c, string_agg(concat(CASE WHEN edit = 'K' THEN role WHEN (place - system) % 2 = 1 THEN 'user' ELSE 'assistant' END, ':', CASE WHEN edit = 'I' THEN '' ELSE text END), chr(10) ORDER BY i) AS whole FROM stay GROUP BY c),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM ids LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN lines l ON l.c = e.c
"""
