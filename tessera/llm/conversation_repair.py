"""Repair of conversation structure by least-cost edits.

A conversation should go `(system? (user assistant)+)?`. Each of its rows may be kept (0), given the role user or assistant (2) or deleted (3; blank rows
and ones that repeat an earlier role and text must be), and empty user or assistant rows may be inserted anywhere (2); a truncated row that stays costs 1 more. States are
what the last row was (none, system, user, assistant); nodes are places between rows in a state, arcs are edits. Forward and backward minimum costs tell
the arcs that lie on a cheapest path (forward + cost + backward = total); the traversal of these takes the least letter of D, I, K, R at each
node. A letter leads from a node to one node, so the frontier of nodes that share the least audit has one member.

A conversation may hold a third of all rows, so nothing runs over a conversation's rows in one piece. Rows are sorted by range, repeats of one row
dealt apart, and cut where they lie into stretches of BLOCK rows at most. For each stretch, all stretches of a batch in step, comes a
4 x 4 matrix of least costs; forward and backward costs at the ends of stretches are folds of these along a conversation, in order and with constant
memory (one short row for each stretch). With both ends known each stretch finds its tight arcs by itself, and where each state at
its begin leads to; a last fold of these gives every stretch its path. Only a digest of a whole conversation has to see its texts in order: it is streamed,
a stretch at a time.

Defined results: null roles and texts are one space, a null conv_id is a conversation of its own, null turns come first; rows of one turn
go by role and text; repeated rows are repeated messages; roles count by their first letter, and others than s, u, a fit nowhere, so they get a new role or go; an empty table
gives no row; columns beyond conv_id, turn, role and text are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm._spark import saved

#: Rows of a stretch.
BLOCK = 512

START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an inserted or re-roled row.
NEXT = (USER, USER, ASSISTANT, USER)
NAME = {USER: "user", ASSISTANT: "assistant"}
RETITLE, DELETE, INSERT, CUT = 2, 3, 2, 1
NEVER = 1 << 40
#: Cost to end in each state, by inserted rows.
FINAL = (0, 4, 2, 0)

_WHITE = " \t\n\x0b\x0c\r"


def _key(conv_id: Column) -> Column:
    return F.coalesce(conv_id.cast("string"), F.lit(""))


def stretches(rows: DataFrame) -> DataFrame:
    """key, block, turns, roles, texts, kinds, blank, cut, same of (conv_id, turn, role, text): rows in order, up to BLOCK of a conversation in each. Blocks of a conversation increase."""
    bare = F.rtrim("text", F.lit(_WHITE))
    first = F.substring("role", 1, 1)
    r = rows.select(_key(F.col("conv_id")).alias("key"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    r = r.withColumn("salt", F.monotonically_increasing_id())
    order = [F.col("key"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("salt")]
    r = r.repartitionByRange(*order).sortWithinPartitions(*order)
    r = r.select(
        "key",
        F.monotonically_increasing_id().alias("at"),
        "turn",
        "role",
        "text",
        F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(0).cast("tinyint").alias("kind"),
        (bare == "").alias("blank"),
        (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"),
        F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("same"),
    )
    lists = {"turns": "long", "roles": "string", "texts": "string", "kinds": "tinyint", "blank": "boolean", "cut": "boolean", "same": "binary"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(0)
            new = np.ones(n, bool)
            new[1:] = np.asarray(pa.compute.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False))
            begins = np.flatnonzero(new)
            since = np.arange(n) - np.repeat(begins, np.diff(np.append(begins, n)))
            at = np.flatnonzero(since % BLOCK == 0)
            offsets = pa.array(np.append(at, n), pa.int32())
            columns = [keys.take(pa.array(at)), batch.column(1).take(pa.array(at))]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.ListArray.from_arrays(offsets, batch.column(k)) for k in range(2, 9)]], names=["key", "block", *lists])

    return r.mapInArrow(run, "key string, block long, " + ", ".join(f"{n} array<{t}>" for n, t in lists.items()))


def repeats(blocks: DataFrame) -> DataFrame:
    """(key, block, repeated): the places in each stretch whose role and text its conversation has before."""
    each = blocks.select("key", "block", F.posexplode("same").alias("pos", "same"))
    first = saved(each.groupBy("key", "same").agg(F.min(F.struct("block", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    later = each.join(first, ["key", "same"]).where(F.struct("block", "pos") > F.col("first"))
    return later.groupBy("key", "block").agg(F.collect_list("pos").alias("repeated"))


class _Steps:
    """The rows of a batch of stretches, taken in step: the longest first, so those that have a row t are the first so many."""

    def __init__(self, kinds: list, gone: list, cut: list):
        size = np.array([len(k) for k in kinds])
        self.n, self.longest = len(size), int(size.max(initial=0))
        self.order = np.argsort(-size, kind="stable")
        self.begin = (np.cumsum(size) - size)[self.order]
        self.live = np.searchsorted(-size[self.order], -np.arange(self.longest), "left")
        kind, gone, cut = (np.concatenate([np.zeros(0, np.int8), *x]) for x in (kinds, gone, cut))
        gone = gone.astype(bool)
        stays = np.where(gone, NEVER, np.where(cut.astype(bool), CUT, 0))
        self.kind = kind
        self.keep = np.where(kind[:, None] == np.arange(4), stays[:, None], NEVER)  # cost to keep a row as system, user, assistant
        self.title = stays + RETITLE
        self.user, self.assistant = (np.minimum(self.keep[:, k], self.title) for k in (USER, ASSISTANT))

    def at(self, t: int) -> tuple[int, np.ndarray]:
        k = int(self.live[t])
        return k, self.begin[:k] + t


def _inserted(m: np.ndarray) -> np.ndarray:
    """Least costs when rows may be inserted first; states are the last axis."""
    m0, m1, m2, m3 = (m[..., s] for s in range(4))
    early = np.minimum(m0, m1) + INSERT
    return np.stack([m0, m1, np.minimum(np.minimum(m2, m3 + INSERT), early), np.minimum(np.minimum(m3, m2 + INSERT), early + INSERT)], -1)


def _advanced(x: np.ndarray, steps: _Steps, rows: np.ndarray) -> np.ndarray:
    """Least costs after one row, from those before it."""
    by = lambda c: c[rows].reshape(-1, *[1] * (x.ndim - 2))
    x0, x1, x2, x3 = (x[..., s] for s in range(4))
    after = [x0 + DELETE, np.minimum(x1 + DELETE, x0 + by(steps.keep[:, SYSTEM])), np.minimum(x2 + DELETE, np.minimum(np.minimum(x0, x1), x3) + by(steps.user)), np.minimum(x3 + DELETE, x2 + by(steps.assistant))]
    return np.minimum(np.stack(after, -1), NEVER)


def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The flags of stretches to (key, block, matrix): least cost from each state before a stretch to each state after it, row by row."""
    for b in batches:
        steps = _Steps(b["kinds"], b["gone"], b["cut"])
        m = np.broadcast_to(np.where(np.eye(4, dtype=bool), 0, NEVER), (steps.n, 4, 4)).copy()
        for t in range(steps.longest):
            k, rows = steps.at(t)
            m[:k] = _advanced(_inserted(m[:k]), steps, rows)
        out = np.empty_like(m)
        out[steps.order] = m
        yield pd.DataFrame({"key": b["key"], "block": b["block"], "matrix": list(out.reshape(-1, 16))})


def _forward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds `before`, the least costs to reach each state at a stretch's begin. Stretches come in order; only the last one's costs are kept."""
    now, costs = None, None
    for b in batches:
        found = []
        for key, m in zip(b["key"], b["matrix"], strict=True):
            if key != now:
                now, costs = key, np.array([0, NEVER, NEVER, NEVER])
            found.append(costs)
            costs = np.minimum((_inserted(costs)[:, None] + _bare(m)).min(0), NEVER)
        yield b.assign(before=found)


def _bare(m) -> np.ndarray:
    return np.asarray(m).reshape(4, 4)


def _backward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds `after`, the least costs from each state at a stretch's end to the end of all, and the total. Stretches come last first."""
    now, costs, total = None, None, 0
    for b in batches:
        found, totals = [], []
        for key, m, before in zip(b["key"], b["matrix"], b["before"], strict=True):
            if key != now:
                now, costs = key, np.array(FINAL)
                total = int((np.asarray(before)[:, None] + _bare(m) + costs).min())
            found.append(costs)
            totals.append(total)
            costs = np.minimum((_bare(m) + costs).min(1), NEVER)
        yield b[["key", "block", "before"]].assign(after=found, total=totals)


def bounds(narrow: DataFrame) -> DataFrame:
    """(key, block, before, after, total) of the matrices of stretches."""
    schema = "key string, block long, matrix array<long>, before array<long>"
    near = narrow.repartition("key")
    forward = near.sortWithinPartitions("key", "block").mapInPandas(_forward, schema)
    return forward.sortWithinPartitions("key", F.desc("block")).mapInPandas(_backward, "key string, block long, before array<long>, after array<long>, total long")


#: What happens to a row: inserts before it (0 to 2) times 3, and D, K or R.
_LETTERS = [i * "I" + x for i in range(3) for x in "DKR"]


def paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Flags and bounds of stretches to (key, block, paths, exits): for each state at a stretch's begin, the edits of the least tight path, a byte a row, and the state in which it ends."""
    keeps = np.full((4, 4), -1)  # state after keeping a row of a kind
    keeps[START, SYSTEM], keeps[[START, SYSTEM, ASSISTANT], USER], keeps[USER, ASSISTANT] = SYSTEM, USER, ASSISTANT
    goes = np.array(NEXT)
    for b in batches:
        steps = _Steps(b["kinds"], b["gone"], b["cut"])
        n = len(steps.kind)
        total = np.repeat(b["total"].to_numpy(), [len(k) for k in b["kinds"]])[:, None]
        ahead, behind, back = (np.empty((n, 4), np.int64) for _ in range(3))  # forward; backward after and before each row
        f = np.stack([*b["before"]])[steps.order]
        for t in range(steps.longest):
            k, rows = steps.at(t)
            ahead[rows] = x = _inserted(f[:k])
            f[:k] = _advanced(x, steps, rows)
        g = np.stack([*b["after"]])[steps.order]
        for t in reversed(range(steps.longest)):
            k, rows = steps.at(t)
            behind[rows] = w = g[:k]
            user, assistant, system = steps.user[rows], steps.assistant[rows], steps.keep[rows, SYSTEM]
            to_user = w[:, USER] + user
            v = np.stack([np.minimum(np.minimum(w[:, 0] + DELETE, w[:, SYSTEM] + system), to_user), np.minimum(w[:, 1] + DELETE, to_user), np.minimum(w[:, 2] + DELETE, w[:, ASSISTANT] + assistant), np.minimum(w[:, 3] + DELETE, to_user)], -1)
            early = np.minimum(v[:, USER] + INSERT, v[:, ASSISTANT] + 2 * INSERT)
            g[:k] = back[rows] = np.minimum(np.stack([np.minimum(v[:, 0], early), np.minimum(v[:, 1], early), np.minimum(v[:, 2], v[:, 3] + INSERT), np.minimum(v[:, 3], v[:, 2] + INSERT)], -1), NEVER)
        # which arcs are tight, of all rows and states at once
        state = np.arange(4)
        kept = keeps[state[None, :], steps.kind[:, None]]
        stay = np.take_along_axis(steps.keep, steps.kind[:, None].astype(int), 1)
        tight = {
            "D": ahead + DELETE + behind == total,
            "I": ahead + INSERT + back[:, goes] == total,
            "K": (kept >= 0) & (ahead + stay + np.take_along_axis(behind, np.maximum(kept, 0), 1) == total),
            "R": ahead + steps.title[:, None] + behind[:, goes] == total,
        }
        code, leads = np.zeros((n, 4), np.uint8), np.zeros((n, 4), np.int8)
        here, done, inserts = np.broadcast_to(state, (n, 4)).copy(), np.zeros((n, 4), bool), np.zeros((n, 4), np.uint8)
        of = lambda a: np.take_along_axis(a, here, 1)
        for _ in range(3):
            for letter, k, to in (("D", 0, here), ("K", 1, of(kept)), ("R", 2, goes[here])):
                take = ~done & of(tight[letter]) & ((letter == "D") | ~of(tight["I"]))
                code[take], leads[take] = (3 * inserts + k)[take], to[take]
                done |= take
            more = ~done & of(tight["I"])
            here, inserts = np.where(more, goes[here], here), inserts + more
        # where each state at a stretch's begin leads to
        took, now = np.zeros((n, 4), np.uint8), np.broadcast_to(state, (steps.n, 4)).copy()
        for t in range(steps.longest):
            k, rows = steps.at(t)
            took[rows] = np.take_along_axis(code[rows], now[:k], 1)
            now[:k] = np.take_along_axis(leads[rows], now[:k], 1)
        exits = np.empty((steps.n, 4), np.int64)
        exits[steps.order] = now
        ends = np.cumsum([len(k) for k in b["kinds"]])
        made = [[took[e - len(k) : e, s].tobytes() for s in range(4)] for e, k in zip(ends, b["kinds"], strict=True)]
        yield pd.DataFrame({"key": b["key"], "block": b["block"], "paths": made, "exits": list(exits)})


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, block, last, exits) in order, to the state in which each stretch begins, and the letters after the last."""
    now, state = None, START
    for b in batches:
        found, tails = [], []
        for key, last, exits in zip(b["key"], b["last"], b["exits"], strict=True):
            if key != now:
                now, state = key, START
            found.append(state)
            state = int(exits[state])
            tails.append("I" * (FINAL[state] // INSERT) if last else "")
        yield b[["key", "block"]].assign(state=found, tail=tails)


def _edited(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts and paths of stretches to their audits and repaired messages."""
    for b in batches:
        out = []
        for key, block, roles, texts, kinds, path, state, tail in b[["key", "block", "roles", "texts", "kinds", "path", "state", "tail"]].itertuples(index=False):
            audit, new_roles, new_texts = [], [], []

            def add(role: str, text: str, new_roles=new_roles, new_texts=new_texts) -> None:
                new_roles.append(role)
                new_texts.append(text)

            for step, role, text, kind in zip(path, roles, texts, kinds, strict=True):
                letters = _LETTERS[step]
                audit.append(letters)
                for letter in letters:
                    if letter == "K":
                        state = int(kind)
                        add(role, text)
                    elif letter != "D":
                        state = NEXT[state]
                        add(NAME[state], "" if letter == "I" else text)
            for _ in tail:
                state = NEXT[state]
                add(NAME[state], "")
            out.append((key, block, "".join(audit) + tail, new_roles, new_texts))
        yield pd.DataFrame(out, columns=["key", "block", "audit", "roles", "texts"])


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables of conversations (conv_id, turn, role, text): reports (key, gaps, blank, duplicate, truncated, illegal, cost), and repaired stretches (key, block, audit,
    roles, texts), of which those of a conversation follow each other by block. key is the conv_id as a string, empty for null.
    """
    blocks = saved(stretches(rows))
    flags = blocks.select("key", "block", "turns", "kinds", "blank", "cut").join(repeats(blocks), ["key", "block"], "left")
    doubled = F.transform("kinds", lambda _, i: F.coalesce(F.array_contains("repeated", i), F.lit(False)))
    flags = flags.withColumn("repeat", doubled).withColumn("gone", F.zip_with("blank", "repeat", lambda a, r: a | r))
    # the first fault of a row counts
    flags = flags.withColumn("cut", F.zip_with("cut", "gone", lambda c, g: c & ~g))
    flags = saved(flags.withColumn("repeat", F.zip_with("repeat", "blank", lambda r, a: r & ~a)))
    shape = flags.select("key", "block", "kinds", "gone", "cut")
    ends = saved(bounds(shape.mapInPandas(matrices, "key string, block long, matrix array<long>")))
    joined = shape.join(ends, ["key", "block"]).select("key", "block", "kinds", "gone", "cut", "before", "after", "total")
    ways = saved(joined.mapInPandas(paths, "key string, block long, paths array<binary>, exits array<long>"))
    along = W.partitionBy("key").orderBy("block")
    exits = ways.select("key", "block", "exits").withColumn("last", F.lead("block").over(along).isNull())
    walked = exits.repartition("key").sortWithinPartitions("key", "block").mapInPandas(_walk, "key string, block long, state long, tail string")
    chosen = ways.join(walked, ["key", "block"]).select("key", "block", F.get("paths", F.col("state").cast("int")).alias("path"), "state", "tail")
    texts = blocks.select("key", "block", "roles", "texts", "kinds").join(chosen, ["key", "block"])
    repaired = texts.mapInPandas(_edited, "key string, block long, audit string, roles array<string>, texts array<string>")
    return _reports(flags, ends), repaired


def _reports(flags: DataFrame, ends: DataFrame) -> DataFrame:
    n = lambda c: F.size(F.filter(c, lambda x: x)).cast("long")
    legal = lambda a, b: ((a == SYSTEM) & (b == USER)) | ((a == USER) & (b == ASSISTANT)) | ((a == ASSISTANT) & (b == USER))
    inner = F.zip_with(F.slice("kinds", 2, BLOCK), F.slice("kinds", F.lit(1), F.size("kinds") - 1), lambda b, a: ~legal(a, b))
    known = F.array_distinct(F.filter("turns", lambda t: t.isNotNull()))
    along = W.partitionBy("key").orderBy("block")
    s = flags.select("key", "block", n("blank").alias("blank"), n("repeat").alias("duplicate"), n("cut").alias("truncated"), n(inner).alias("inner"), F.get("kinds", F.lit(0)).alias("k0"), F.element_at("kinds", -1).alias("k1"), F.size(known).cast("long").alias("turns"), F.array_min(known).alias("t0"), F.array_max(known).alias("t1"))
    before = F.lag("k1").over(along)
    s = s.withColumn("edge", (before.isNotNull() & ~legal(before, F.col("k0"))).cast("long"))
    s = s.withColumn("shared", F.coalesce((F.lag("t1").over(along) == F.col("t0")).cast("long"), F.lit(0)))
    total = ends.groupBy("key").agg(F.min("total").alias("cost"))
    gaps = F.coalesce(F.max("t1") - F.min("t0") + 1 - (F.sum("turns") - F.sum("shared")), F.lit(0))
    out = s.groupBy("key").agg(gaps.alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")], (F.sum("inner") + F.sum("edge")).alias("illegal"))
    return out.join(total, "key")


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stretches in order to (key, audit, digest of `role:text` lines), one conversation after the other."""
    now, audit, digest, empty = None, [], None, True
    for b in batches:
        out = []
        for key, part, roles, texts in zip(b["key"], b["audit"], b["roles"], b["texts"], strict=True):
            if key != now:
                if now is not None:
                    out.append((now, "".join(audit), digest.hexdigest()))
                now, audit, digest, empty = key, [], hashlib.sha256(), True
            audit.append(part)
            lines = "\n".join(f"{r}:{t}" for r, t in zip(roles, texts, strict=True))
            if len(roles):
                digest.update(("" if empty else "\n").encode() + lines.encode("utf-8", "surrogatepass"))
                empty = False
        yield pd.DataFrame(out, columns=["key", "audit", "repaired_sha256"])
    if now is not None:
        yield pd.DataFrame([(now, "".join(audit), digest.hexdigest())], columns=["key", "audit", "repaired_sha256"])


def digests(repaired: DataFrame) -> DataFrame:
    """key, audit, repaired_sha256: of each conversation's stretches, streamed in order."""
    return repaired.repartition("key").sortWithinPartitions("key", "block").mapInPandas(_digest, "key string, audit string, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations as the contract damages them, by the CRC of `conv_id:turn`."""
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    r = rows.select("conv_id", "turn", *[F.coalesce(F.col(c), blank).alias(c) for c in ("role", "text")], (F.crc32(F.encode(name, "UTF-8")) % 20).alias("hit")).where("hit <> 0")
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    r = r.withColumns({"text": text, "role": F.when(F.col("hit") == 4, "user").otherwise(F.col("role")), "copy": F.explode(F.sequence(F.lit(0), F.when(F.col("hit") == 3, 1).otherwise(0)))})
    return r.select("conv_id", "turn", "role", "text")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    reports, repaired = repair(damaged(rows))
    every = rows.select("conv_id").distinct().withColumn("key", _key(F.col("conv_id")))
    out = every.join(reports, "key", "left").join(digests(repaired), "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
