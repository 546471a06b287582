"""Conversation structure repair by iterative-deepening A*.

The cheapest edits make the role initials of a conversation read ``(s?(ua)+)?``: Delete 3 (rows that are blank or repeat an earlier row must go), Insert an
empty turn 2, Keep 0, Rerole to user or assistant 2, and 1 more for a row that stays without an end of sentence. A depth-first search takes the edits in
ASCII order under increasing bounds of the cost, with a table of states that failed, so the first path it accepts is the answer.

Identical rows are counted, rows are put in order by a range shuffle that splits any conversation, and the ordered rows are cut into blocks of at most
``BLOCK`` rows of one conversation. What the rest of a conversation costs from each state at the end of a block passes backwards over the blocks, so
each block is searched by itself, from every state it may be entered in, and the answers are linked forwards. A segment ends with its last row, hence the
first accepted segments together are the first accepted path. All passes over a conversation hold one batch of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from txrisk.llm.common import store

BLOCK = 128
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
# Roles read so far: none, s, ..u, ..a; what comes next when the row or the edit has the initial.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
WANTED = ("user", "user", "assistant", "user")
# The least each kind of row costs: capital letters are truncated rows, x must go, o has another initial.
LEAST = {"s": 0, "u": 0, "a": 0, "o": REROLE, "S": TRUNCATED, "U": TRUNCATED, "A": TRUNCATED, "O": min(REROLE + TRUNCATED, DELETE), "x": DELETE}
FAR = 1 << 60


def _after(state: int) -> int:
    """State after an inserted or reroled turn."""
    return NEXT[state, WANTED[state][0]]


def ends() -> list[int]:
    """What it costs to end a conversation in each state."""
    return [0, 2 * INSERT, INSERT, 0]


def first_repair(codes: str, entry: int, togo: list[int], last: bool) -> tuple[str, int]:
    """Edits of a block's rows and the state at its end: of the cheapest, the first in ASCII order.

    ``togo`` has the cost of all that follows the block by the state at its end; the ``last`` block may insert turns behind its rows.
    """
    n, least = len(codes), [0] * (len(codes) + 1)
    least[n] = min(togo)
    for i in range(n - 1, -1, -1):
        least[i] = least[i + 1] + LEAST[codes[i]]
    failed: dict[tuple[int, int], int] = {}
    path: list[str] = []

    def search(i: int, state: int, left: int) -> int:
        """The state at the end of the first path that costs at most ``left``, or -1."""
        if left < least[i] or failed.get((i, state), -1) >= left:
            return -1
        if i == n and (not last or togo[state] == 0):
            if togo[state] <= left:
                return state
        else:
            code = codes[i] if i < n else ""
            more = TRUNCATED if code.isupper() else 0
            edits = [("D", i + 1, state, DELETE)] if code else []
            edits.append(("I", i, _after(state), INSERT))
            if code and code != "x":
                if (to := NEXT.get((state, code.lower()))) is not None:
                    edits.append(("K", i + 1, to, more))
                edits.append(("R", i + 1, _after(state), REROLE + more))
            for letter, j, to, cost in edits:
                path.append(letter)
                if (end := search(j, to, left - cost)) >= 0:
                    return end
                path.pop()
        failed[i, state] = max(failed.get((i, state), -1), left)
        return -1
    bound = least[0]
    while (end := search(0, entry, bound)) < 0:
        bound += 1
    return "".join(path), end


def costs_before(codes: str, togo: list[int]) -> list[int]:
    """Least cost from each state before a block, given the costs behind it."""
    for code in reversed(codes):
        more, row = TRUNCATED if code.isupper() else 0, []
        for state in range(4):
            best = togo[state] + DELETE
            if code != "x":
                best = min(best, togo[_after(state)] + REROLE + more, togo[NEXT[state, code.lower()]] + more if (state, code.lower()) in NEXT else FAR)
            row.append(best)
        # turns inserted before the row; a third one leads back to a state that is passed already
        one = [min(row[s], INSERT + row[_after(s)]) for s in range(4)]
        togo = [min(row[s], INSERT + one[_after(s)]) for s in range(4)]
    return togo


# ------------------------------------------------------------------------------------------------ passes over ordered rows

ORDER = ["key", "turn", "role", "digest"]
PLACED = "key string, turn long, role string, digest binary, blank boolean, copies long, again long, truncated boolean, part long, block long, place long, codes string, initials string"
LINKED = "key string, part long, block long, codes string, initials string, togo array<long>, alone boolean, last boolean"
FOUND = "key string, part long, block long, initials string, audits array<string>, exits array<int>"
EDITS = "key string, part long, block long, entry int, audit string, illegal long"
LOG = "key string, turn long, role string, digest binary, at long, edits array<string>, roles array<string>, cost long"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        names = batch.schema.names
        for values in zip(*(c.to_pylist() for c in batch.columns)):
            yield dict(zip(names, values))


def _out(rows: Iterator[dict], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _pass(df: DataFrame, run, schema: str) -> DataFrame:
    """``run`` turns the rows of a partition, one after the other, into rows of ``schema``."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(lambda batches: _out(run(_rows(batches)), arrow), schema)


def _blocks(rows: Iterator[dict]) -> Iterator[dict]:
    """Rows numbered by block and place; identical rows beyond a block are dealt to several; the first row of a block has its codes."""
    part, block, held, size = TaskContext.get().partitionId(), 0, [], 0

    def close() -> Iterator[dict]:
        codes = initials = ""
        for r in held:
            first = r["role"][:1]
            kind = first if first in ("s", "u", "a") else "o"
            codes += ("x" if r["blank"] or r["again"] == r["copies"] else kind.upper() if r["truncated"] else kind) + "x" * (r["copies"] - 1)
            initials += (first or " ") * r["copies"]
        for place, r in enumerate(held):
            yield {**r, "part": part, "block": block, "place": place, "codes": None if place else codes, "initials": None if place else initials}
    for row in rows:
        left, known = row["copies"], not row["first"]
        while left:
            if held and (held[0]["key"] != row["key"] or size == BLOCK):
                yield from close()
                block, held, size = block + 1, [], 0
            n = min(left, BLOCK - size)
            held.append({**row, "copies": n, "again": 0 if row["blank"] else n - (not known), "truncated": row["truncated"] and not known and not row["blank"]})
            left, known, size = left - n, True, size + n
    if held:
        yield from close()


def _backwards(rows: Iterator[dict]) -> Iterator[dict]:
    """Blocks of a conversation from the last to the first, with the costs behind them."""
    later = None
    for row in rows:
        same = later is not None and later["key"] == row["key"]
        if later is not None:
            yield {**later, "alone": later["last"] and not same}
        togo = costs_before(later["codes"], later["togo"]) if same else ends()
        later = {**row, "togo": togo, "last": not same}
    if later is not None:
        yield {**later, "alone": later["last"]}


def _search(rows: Iterator[dict]) -> Iterator[dict]:
    for row in rows:
        found = [first_repair(row["codes"], s, row["togo"], row["last"]) for s in ([START] if row["alone"] else range(4))]
        yield {**row, "audits": [a for a, _ in found], "exits": [e for _, e in found]}


def _forwards(rows: Iterator[dict]) -> Iterator[dict]:
    """Blocks of a conversation from the first to the last, each entered in the state in which the one before ends."""
    key, state, before = None, START, ""
    for row in rows:
        if row["key"] != key:
            key, state, before = row["key"], START, ""
        seen = before + row["initials"]
        yield {**row, "entry": state, "audit": row["audits"][state if len(row["audits"]) > 1 else 0],
               "illegal": sum(seen[i:i + 2] not in ("su", "ua", "au") for i in range(len(seen) - 1))}
        state, before = row["exits"][state if len(row["exits"]) > 1 else 0], seen[-1]


def _log(rows: Iterator[dict]) -> Iterator[dict]:
    """What happens at every row of a block: edits in order, the role each of them leaves, and their cost."""
    at, block, state = 0, None, START
    for row in rows:
        if (row["part"], row["block"]) != block:
            block, at, state = (row["part"], row["block"]), 0, row["entry"]
        edits, roles, cost, left, audit = [], [], 0, row["copies"], row["audit"]
        while at < len(audit) and (left or set(audit[at:]) == {"I"}):
            letter = audit[at]
            role = None if letter == "D" else row["role"] if letter == "K" else WANTED[state]
            cost += {"D": DELETE, "I": INSERT, "K": 0, "R": REROLE}[letter] + TRUNCATED * (row["truncated"] and letter in "KR")
            state = state if letter == "D" else NEXT[state, role[:1]]
            edits.append(letter)
            roles.append(role)
            at, left = at + 1, left - (letter != "I")
        yield {**row, "at": row["place"], "edits": edits, "roles": roles, "cost": cost}


def _digests(rows: Iterator[dict]) -> Iterator[dict]:
    """Texts and edits of a conversation, in order, as its cost, its audit and the digest of what is left."""
    key, text, cost, audit, digest, empty = None, "", 0, [], hashlib.sha256(), True
    for row in rows:
        if row["key"] != key:
            if key is not None:
                yield {"key": key, "cost": cost, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}
            key, cost, audit, digest, empty = row["key"], 0, [], hashlib.sha256(), True
        if row["edits"] is None:
            text = row["text"]
            continue
        cost += row["cost"]
        audit.append("".join(row["edits"]))
        for edit, role in zip(row["edits"], row["roles"]):
            if edit != "D":
                digest.update((("" if empty else "\n") + role + ":" + ("" if edit == "I" else text)).encode())
                empty = False
    if key is not None:
        yield {"key": key, "cost": cost, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}


# ------------------------------------------------------------------------------------------------ the operator

def _key(conversation: Column) -> Column:
    return F.when(conversation.isNull(), "-").otherwise(F.concat(F.lit("="), conversation.cast("string")))


def _filled(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(" "))


def repair_log(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ordered rows, blocks with their edits, and the edits at every row, from the rows of ``_named``."""
    bare = F.rtrim("text", F.lit(" \t\n\x0b\f\r"))
    narrow = rows.withColumns({"blank": bare == "", "truncated": ~F.substring(bare, -1, 1).isin(".", "!", "?")})
    counted = narrow.groupBy(*ORDER, "blank", "truncated").agg(F.count("*").alias("copies"))
    # nulls come first: a known turn is later than none
    since = F.struct(F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0)))
    firsts = counted.groupBy("key", "role", "digest").agg(F.min(since).alias("since"))
    ordered = counted.join(firsts, ["key", "role", "digest"]).select(*counted.columns, (since == F.col("since")).alias("first"))
    placed, _ = store(_pass(ordered.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER), _blocks, PLACED), "repair-placed")
    blocks = placed.where("codes IS NOT NULL").select("key", "part", "block", "codes", "initials")
    back = _pass(blocks.repartition("key").sortWithinPartitions("key", F.desc("part"), F.desc("block")), _backwards, LINKED)
    found = _pass(back.repartition("part", "block"), _search, FOUND)
    edits, _ = store(_pass(found.repartition("key").sortWithinPartitions("key", "part", "block"), _forwards, EDITS), "repair-edits")
    joined = placed.drop("codes", "initials").join(edits.drop("key", "illegal"), ["part", "block"])
    log = _pass(joined.repartition("part", "block").sortWithinPartitions("part", "block", "place"), _log, "part long, block long, " + LOG)
    return placed, edits, log


def _named(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    key = F.when(rows[conv_col].isNull(), "-").otherwise(F.concat(F.lit("="), rows[conv_col].cast("string")))
    filled = lambda c: F.coalesce(rows[c].cast("string"), F.lit(" "))
    named = rows.select(rows[conv_col].alias("conv"), key.alias("key"), rows[turn_col].cast("long").alias("turn"), filled(role_col).alias("role"), filled(text_col).alias("text"))
    return named.withColumn("digest", F.unhex(F.md5("text")))


def repair_conversations(rows: DataFrame, every: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text") -> DataFrame:
    """One row per conversation: its faults, the cost and letters of the cheapest edits, and the digest of what they leave.

    (conversation, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for each conversation of ``every``, of the rows by default. Rows are
    ordered by turn, nulls first; rows of one turn by role, then by a digest of the text. A null conversation is one conversation; null roles and texts count as
    one space, and an empty role as an initial that fits nowhere. Identical rows all count; all but one are duplicates. A conversation without rows has zeros, an empty audit
    and the digest of nothing; an empty table gives no rows; other columns are not read.
    """
    named = _named(rows, conv_col, turn_col, role_col, text_col)
    placed, edits, log = repair_log(named.drop("conv"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0))
    faults = placed.groupBy("key").agg(gaps.alias("gaps"), F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
                                       F.sum("again").alias("duplicate"), F.sum(F.col("truncated").cast("long")).alias("truncated"))
    illegal = edits.groupBy("key").agg(F.sum("illegal").alias("illegal"))
    # the text of a row stands before the edits at it
    none = lambda kind: F.lit(None).cast(kind)
    texts = named.select(*ORDER, F.lit(-1).cast("long").alias("part"), F.lit(-1).cast("long").alias("block"), none("long").alias("at"), "text",
                         none("array<string>").alias("edits"), none("array<string>").alias("roles"), none("long").alias("cost"))
    both = texts.unionByName(log.withColumn("text", none("string")))
    read = both.repartition("key").sortWithinPartitions(*ORDER, "part", "block", "at")
    digests = _pass(read, _digests, "key string, cost long, audit string, repaired_sha256 string")
    report = faults.join(illegal, "key").join(digests, "key")
    own = named if every is None else _named(every.select(every[conv_col].alias("c"), *[F.lit(None).alias(x) for x in "trx"]), "c", "t", "r", "x")
    own = own.select("conv", "key").distinct()
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return own.join(report, "key", "left").select(F.col("conv").alias(conv_col), *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                                                  F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def repaired_rows(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conversation, part, block, at, step, edit, role, text): the repaired conversations, in the order of these columns.

    Kept and reroled rows have their text, inserted ones an empty text; deleted rows are left out. Nulls, ties and repeated rows as in ``repair_conversations``.
    """
    named = _named(rows, conv_col, turn_col, role_col, text_col)
    _, _, log = repair_log(named.drop("conv"))
    texts = named.dropDuplicates(ORDER).select("conv", *[F.col(c).alias(f"own_{c}") for c in ORDER], "text")
    steps = log.select(*ORDER, "part", "block", "at", F.posexplode(F.arrays_zip("edits", "roles")).alias("step", "e")).where("e.edits <> 'D'")
    same = [steps[c].eqNullSafe(texts[f"own_{c}"]) for c in ORDER]
    return steps.join(texts, same).select(F.col("conv").alias(conv_col), "part", "block", "at", "step", F.col("e.edits").alias("edit"), F.col("e.roles").alias(role_col),
                                          F.when(F.col("e.edits") == "I", "").otherwise(F.col("text")).alias(text_col))
