"""Rebuilding conversations from message rows (problem 5).

1. The links of a session give each entry of its chain a sequence number, its depth below the root. Sessions of up to ``BUCKET``
   delivered rows are linked in the task that their rows are sent to, larger ones by pointer doubling over DataFrames, which numbers them
   alike; no task ever holds more than ``BUCKET`` rows of a session.
2. The numbered rows are partitioned by conversation and secondary-sorted by sequence number.
3. A finite-state automaton streams over them and validates roles, empty turns and missing replies. A conversation that spans several
   buckets has a transition table for each; the tables are composed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamark.session import cut

#: Spellings of the four roles after trimming, lower case and removal of ``_``, ``-`` and blanks.
ROLES = {
    "user": "user", "human": "user",
    "assistant": "assistant", "ai": "assistant", "model": "assistant", "bot": "assistant",
    "system": "system", "developer": "system",
    "toolresult": "toolResult", "tool": "toolResult", "toolresponse": "toolResult", "function": "toolResult", "functionresult": "toolResult",
}
#: Rows of one session that a task holds.
BUCKET = 50_000

# Symbols of the automaton: 0 other, 1 user with text, 2 user without text, 3 assistant with text.
# States: 0 no user message yet, 1 a user message waits for its reply, 2 replied, 3 rejected. Accepting: 2.
STEP = ((0, 1, 3, 0), (1, 3, 3, 2), (2, 1, 3, 2), (3, 3, 3, 3))
ACCEPT = 2


def role(c: Column) -> Column:
    """One of user, assistant, system, toolResult, whatever the spelling; null for null and unknown roles."""
    key = F.regexp_replace(F.lower(c), r"[\s_\-]+", "")
    pairs = [x for k, v in ROLES.items() for x in (F.lit(k), F.lit(v))]
    return F.create_map(*pairs)[key]


def prepare(entries: DataFrame) -> DataFrame:
    """Narrow rows for the automaton: keys, link, symbol, time and a digest of the content instead of the text."""
    r = role(F.col("msg_role"))
    has_text = F.coalesce(F.col("content_text").rlike(r"(?U)\S"), F.lit(False))
    symbol = F.when((r == "user") & has_text, 1).when(r == "user", 2).when((r == "assistant") & has_text, 3).otherwise(0)
    is_message = F.coalesce(F.col("entry_type") == "message", F.lit(False))
    return entries.filter(F.col("session_id").isNotNull()).select(
        "session_id", "entry_id", "parent_entry_id",
        F.when(is_message, symbol).otherwise(-1).cast("byte").alias("symbol"),
        F.when(is_message, r).alias("role"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.xxhash64(F.struct("parent_entry_id", "entry_type", F.coalesce(r, F.lower(F.trim("msg_role"))).alias("r"), "content_text")).alias("digest"),
    )


def chain_of(rows: list[tuple]) -> list[tuple] | None:
    """The chain of one session, (entry, symbol, role) by depth, from its rows (entry, parent, symbol, role, us, digest); None if it is broken.

    Of an entry delivered several times the newest non-null time counts; of equal newest entries the greater id.
    """
    by: dict = {}
    for e, parent, symbol, rl, us, digest in rows:
        old = by.get(e)
        if old is None:
            if e is None:
                return None
            by[e] = [parent, symbol, rl, us, digest]
        elif old[4] != digest:
            return None
        elif us is not None and (old[3] is None or us > old[3]):
            old[3] = us
    roots = [e for e, v in by.items() if v[0] is None]
    if len(roots) != 1:
        return None
    children: dict = {}
    for e, v in by.items():
        if v[0] is not None:
            if v[0] not in by:
                return None
            children.setdefault(v[0], []).append(e)
    seen, stack = 0, [roots[0]]
    forked = any(len(c) > 1 for c in children.values())
    while stack:
        seen += 1
        stack.extend(children.get(stack.pop(), ()))
    if seen != len(by):
        return None
    if forked:
        tip = max(by, key=lambda e: (by[e][3] is not None, by[e][3] or 0, e))
        line = []
        while tip is not None:
            line.append(tip)
            tip = by[tip][0]
        line.reverse()
        while len(nxt := children.get(line[-1], ())) == 1:
            line.append(nxt[0])
    else:
        line, at = [], roots[0]
        while at is not None:
            line.append(at)
            at = children[at][0] if at in children else None
    return [(e, by[e][1], by[e][2]) for e in line]


SEQUENCE = "session_id string, seq long, entry_id string, symbol byte, role string"
OUT = "session_id string, turn_no long, entry_id string, role string"


def _flushed(out: list[list], types: tuple, names: tuple) -> pa.RecordBatch:
    b = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names=list(names))
    for x in out:
        x.clear()
    return b


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sessions arrive one after the other; at most one is held."""
    types, names = (pa.string(), pa.int64(), pa.string(), pa.int8(), pa.string()), ("session_id", "seq", "entry_id", "symbol", "role")
    now, rows = None, []
    out: list[list] = [[] for _ in types]

    def close() -> None:
        for k, (e, symbol, rl) in enumerate((chain_of(rows) if rows else None) or ()):
            if symbol >= 0:
                for x, v in zip(out, (now, k, e, symbol, rl)):
                    x.append(v)

    for b in batches:
        sid, *cols = (c.to_pylist() for c in b.columns)
        for s, row in zip(sid, zip(*cols)):
            if s != now:
                close()
                now, rows = s, []
            rows.append(row)
        if len(out[0]) > 20_000:
            yield _flushed(out, types, names)
    close()
    yield _flushed(out, types, names)


RUN = "session_id string, bucket long, n long, turn long, entry_id string, role string, ends array<int>"


def _automaton(batches: Iterator[pa.RecordBatch], single: bool) -> Iterator[pa.RecordBatch]:
    """Rows in order of conversation, bucket and sequence. ``ends`` is where a bucket leads from each state; with ``single`` a conversation
    has one bucket and comes out only if that accepts it."""
    types, names = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())), ("session_id", "bucket", "n", "turn", "entry_id", "role", "ends")
    now, held = None, []
    out: list[list] = [[] for _ in types]
    ends = list(range(4))

    def close() -> None:
        if held and not (single and ends[0] != ACCEPT):
            for k, (e, rl) in enumerate(held, 1):
                for x, v in zip(out, (*now, len(held), k, e, rl, ends)):
                    x.append(v)

    for b in batches:
        for sid, bucket, e, symbol, rl in zip(*(c.to_pylist() for c in b.columns)):
            if (sid, bucket) != now:
                close()
                now, held, ends = (sid, bucket), [], list(range(4))
            held.append((e, rl))
            ends = [STEP[x][symbol] for x in ends]
        if len(out[0]) > 20_000:
            yield _flushed(out, types, names)
    close()
    yield _flushed(out, types, names)


def validated(numbered: DataFrame, single: bool) -> DataFrame:
    """The accepted conversations of numbered messages, ``turn_no`` from 1; ``single`` if none has more than one bucket."""
    n = numbered.withColumn("bucket", F.lit(0).cast("long") if single else F.floor(F.col("seq") / BUCKET))
    ordered = n.repartition("session_id", "bucket").sortWithinPartitions("session_id", "bucket", "seq").select("session_id", "bucket", "entry_id", "symbol", "role")
    run = ordered.mapInArrow(lambda batches: _automaton(batches, single), RUN)
    if single:
        return run.select("session_id", F.col("turn").alias("turn_no"), "entry_id", "role")
    run = cut(run)
    tables = run.filter("turn = 1").groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("bucket", "n", "ends"))).alias("b"))
    tables = tables.filter(F.aggregate("b", F.lit(0), lambda s, x: x["ends"][s]) == ACCEPT)
    before = F.transform("b", lambda x: F.struct(x["bucket"].alias("bucket"), F.aggregate(F.filter("b", lambda y: y["bucket"] < x["bucket"]), F.lit(0).cast("long"), lambda s, y: s + y["n"]).alias("before")))
    offsets = tables.select("session_id", F.explode(before).alias("o")).select("session_id", "o.*")
    return run.join(offsets, ["session_id", "bucket"]).select("session_id", (F.col("before") + F.col("turn")).alias("turn_no"), "entry_id", "role")


def _doubled(rows: DataFrame) -> DataFrame:
    """The numbered messages of large sessions: no step holds a session, or a share of one that grows with it, in one task."""
    e = rows.groupBy("session_id", "entry_id").agg(
        F.min("digest").alias("d0"), F.max("digest").alias("d1"), F.max("us").alias("us"), F.first("parent_entry_id").alias("parent"), F.first("symbol").alias("symbol"), F.first("role").alias("role")
    )
    e = cut(e)
    parents = e.select("session_id", F.col("entry_id").alias("parent"), F.lit(True).alias("known"))
    bad = e.join(parents, ["session_id", "parent"], "left").groupBy("session_id").agg(
        F.max((F.col("d0") != F.col("d1")) | F.col("entry_id").isNull()).alias("conflict"), F.sum(F.col("parent").isNull().cast("int")).alias("roots"),
        F.max(F.col("parent").isNotNull() & F.col("known").isNull()).alias("orphan"), F.count("*").alias("n"), F.max_by("entry_id", F.struct(F.col("us").isNotNull(), "us", "entry_id")).alias("tip"),
    )
    ok = cut(bad.filter(~F.col("conflict") & (F.col("roots") == 1) & ~F.col("orphan")).select("session_id", "n", "tip"))
    e = e.join(ok.select("session_id"), "session_id", "left_semi")
    most = ok.agg(F.max("n")).collect()[0][0]
    if most is None:
        return rows.sparkSession.createDataFrame([], SEQUENCE)
    # pointer doubling: after k rounds ``anc`` is the ancestor 2^k steps up and ``depth`` counts the steps taken
    jump = cut(e.select("session_id", "entry_id", F.col("parent").alias("anc"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth")))
    jumps, k = [jump], 0
    while (1 << k) <= most and not jump.filter(F.col("anc").isNotNull()).isEmpty():
        up = jump.select("session_id", F.col("entry_id").alias("anc"), F.col("anc").alias("anc2"), F.col("depth").alias("depth2"))
        jump = cut(jump.join(up, ["session_id", "anc"], "left").select("session_id", "entry_id", F.col("anc2").alias("anc"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth")))
        jumps.append(jump)
        k += 1
    # what still has an ancestor after so many steps lies on a cycle
    cyclic = jump.filter(F.col("anc").isNotNull()).select("session_id").distinct()
    ok = ok.join(cyclic, "session_id", "left_anti")
    depth = jump.select("session_id", "entry_id", "depth")
    # below the tip the line goes on as long as there is a single successor: walk down through single children by doubling as well
    single = e.filter(F.col("parent").isNotNull()).groupBy("session_id", "parent").agg(F.count("*").alias("c"), F.first("entry_id").alias("child")).filter("c = 1").select("session_id", F.col("parent").alias("entry_id"), F.col("child").alias("nxt"))
    down = cut(e.select("session_id", "entry_id").join(single, ["session_id", "entry_id"], "left").select("session_id", "entry_id", F.coalesce("nxt", "entry_id").alias("last")))
    for _ in range(len(jumps)):
        hop = down.select("session_id", F.col("entry_id").alias("last"), F.col("last").alias("last2"))
        down = cut(down.join(hop, ["session_id", "last"]).select("session_id", "entry_id", F.col("last2").alias("last")))
    line = ok.select("session_id", F.col("tip").alias("entry_id")).join(down, ["session_id", "entry_id"]).select("session_id", F.col("last").alias("entry_id"))
    for j in reversed(jumps):
        up = line.join(j, ["session_id", "entry_id"]).filter(F.col("anc").isNotNull()).select("session_id", F.col("anc").alias("entry_id"))
        line = cut(line.unionByName(up).distinct())
    line = line.join(depth, ["session_id", "entry_id"]).join(e.select("session_id", "entry_id", "symbol", "role"), ["session_id", "entry_id"]).filter("symbol >= 0")
    return line.select("session_id", F.col("depth").alias("seq"), "entry_id", "symbol", "role")


def rebuild_conversations(entries: DataFrame, with_text: bool = True, held: int = BUCKET) -> DataFrame:
    """The messages of the kept sessions in order: ``session_id, turn_no, entry_id, role`` and, if wanted, ``content_text``.

    Defined cases: rows without a session are no part of any; a null entry id breaks its session; an entry delivered again with the
    same parent, type, role and text is one entry, with other content it breaks the session; blank means white space only; a message of
    unknown role is numbered but answers nothing; a fork follows the branch of the newest entry by ``ts`` (equal times: greater id;
    entries without a time come last) and below it single successors to the end. Empty input gives no rows; extra columns are ignored.
    """
    rows = prepare(entries)
    large = rows.groupBy("session_id").count().filter(F.col("count") > held).select("session_id")
    big = cut(large) if not large.isEmpty() else None
    small = rows if big is None else rows.join(big, "session_id", "left_anti")
    ordered = small.repartition("session_id").sortWithinPartitions("session_id", "entry_id")
    linked = ordered.select("session_id", "entry_id", "parent_entry_id", "symbol", "role", "us", "digest").mapInArrow(_link, SEQUENCE)
    out = validated(linked, True)
    if big is not None:
        out = out.unionByName(validated(_doubled(rows.join(big, "session_id", "left_semi")), False))
    if with_text:
        # texts meet the kept entries as they were delivered; of repeated ones, which are alike, one is left where they meet
        text = entries.select("session_id", "entry_id", "content_text").filter(F.col("session_id").isNotNull() & F.col("entry_id").isNotNull())
        out = out.join(text, ["session_id", "entry_id"]).dropDuplicates(["session_id", "entry_id"]).select("session_id", "turn_no", "entry_id", "role", "content_text")
    return out
