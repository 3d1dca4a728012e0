"""Prefix trie of conversations from a Cartesian tree over their LCP array.

Every turn is a 128-bit digest of role and text, a conversation the array of its
turns' digests; texts are read once and never moved.  Equal conversations become one
sequence with a weight.  The sequences are sorted over ranges, and each is compared
with the one before: L[i] is the number of turns that sequences i - 1 and i share.
A node of the Cartesian tree over L is an interval of sequences between its previous
and its next smaller value; positions of equal value between the same two are one node.
Depths that no position has (one child only) are filled in on the way to the parent,
and what a node counts is a difference of running sums at its interval's ends.

Nearest smaller values are found block by block.  A stack finds those within a block;
the block also leaves its minimum, its running minima from either end (the only
positions that another block can find as its nearest smaller value) and its sums.  A
value that finds none in its block looks up the nearest block whose minimum is smaller,
and joins that block's running minima.  The driver holds a few numbers per block.

Results of trie(): for each node the smallest member, depth, the parent's smallest
member, members, children, childless nodes below or at it, saved_tokens (over the
nodes below and at it, (members - 1) times the bytes of the node's text) and the
SHA-256 of the ids of the conversations that end there, ascending, comma-joined.

Ids that end at one node are hashed in order whatever their number: runs of a range
partition become one string each, and one task adds up strings.

Defined cases: rows with a null id are left out; null role or text is empty; turns are
ordered by turn, null first, equal turns by their digest, so repeated rows are turns of
their own and file order never matters; extra columns are not read; an empty table
gives no rows, not even a root.  A conversation's digests and lengths (about 40 bytes a
turn) meet in one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import lasting, let, small, stored, temporary, whole

#: Sequences and turns of a block.
BLOCK, TURNS = 16_384, 1 << 20
NOTHING = hashlib.sha256(b"").hexdigest()
#: What running sums add up before a sequence: members, members times bytes, bytes that no sequence before has, sequences that none before leads to.
SUMS = ["ws", "wt", "e", "x"]


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, digests, sizes) of each conversation, from rows (conv_id, turn, role, text)."""
    role, text = whole("role"), whole("text")
    named = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)
    row = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"), F.unhex(F.substring(named, 1, 32)).alias("digest"), F.octet_length(text).cast("long").alias("size"))
    own = turns.filter("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(row)).alias("t"))
    return own.select("conv_id", F.col("t.digest").alias("digests"), F.col("t.size").alias("sizes"))


def rebuilt(own: DataFrame) -> DataFrame:
    """Each conversation with its first h turns taken from conversation c - c % 5; h = crc32(decimal c) % 9."""
    own = stored(own)
    heads = own.select(F.col("conv_id").alias("base"), F.slice("digests", 1, 8).alias("head"), F.slice("sizes", 1, 8).alias("head_sizes"))
    h = (F.crc32(F.col("conv_id").cast("string")) % 9).cast("int")
    joined = own.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % 5).join(heads, "base", "left")
    put = lambda head, rest: F.when(F.col(head).isNull(), F.slice(rest, F.col("h") + 1, F.size(rest))).otherwise(F.concat(F.slice(head, F.lit(1), F.col("h")), F.slice(rest, F.col("h") + 1, F.size(rest))))
    return joined.select("conv_id", put("head", "digests").alias("digests"), put("head_sizes", "sizes").alias("sizes"))


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows of one key, sorted, as one string each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        k1, k2, ids = (batch.column(i).to_numpy() for i in range(3))
        at = np.concatenate([[0], np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1])
        text = [",".join(map(str, x.tolist())) for x in np.split(ids, at[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(k1[at]), pa.array(k2[at]), pa.array(ids[at]), pa.array(text)], ["k1", "k2", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's strings, comma-joined, from rows sorted by key and first id."""
    kind = ["k1", "k2", "sha"]
    key, sha = None, None
    for batch in batches:
        out = []
        for k1, k2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
            if (k1, k2) != key:
                if key is not None:
                    out.append((*key, sha.hexdigest()))
                key, sha = (k1, k2), hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(text.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], kind)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([sha.hexdigest()])], kind)


def ends(rows: DataFrame) -> DataFrame:
    """(k1, k2, sha) from rows (k1, k2, conv_id): SHA-256 of a key's ids, ascending, comma-joined."""
    keys = ["k1", "k2"]
    runs = rows.repartitionByRange(*keys, "conv_id").sortWithinPartitions(*keys, "conv_id").mapInArrow(_strings, "k1 long, k2 long, first long, ids string")
    return runs.repartition(*keys).sortWithinPartitions(*keys, "first").mapInArrow(_digests, "k1 long, k2 long, sha string")


LINE = "block long, pos long, length int, lcp int, ext int, cum array<long>, w long, conv long, sha string, part int, digests array<binary>"
_LINE = pa.schema([("block", pa.int64()), ("pos", pa.int64()), ("length", pa.int32()), ("lcp", pa.int32()), ("ext", pa.int32()), ("cum", pa.list_(pa.int64())), ("w", pa.int64()), ("conv", pa.int64()), ("sha", pa.string()), ("part", pa.int32()), ("digests", pa.list_(pa.binary()))])


def _lines(block: int):
    """Sorted sequences with their place, block and shared turns; a partition's first and last keep their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        i, last, start, turns, edge = 0, None, part << 40, 0, None
        for batch in batches:
            rows = []
            columns = [batch.column(k) for k in range(5)]
            for k in range(batch.num_rows):
                held = columns[0][k]
                own = np.frombuffer(b"".join(held.as_py()), "<u8").reshape(-1, 2)
                if last is None:
                    lcp, ext = -1, 0
                else:
                    m = min(len(own), len(last))
                    differ = np.flatnonzero((own[:m] != last[:m]).any(axis=1))
                    lcp = int(differ[0]) if len(differ) else m
                    ext = int(lcp == len(last))
                pos = part << 40 | i
                if pos - start >= block or turns >= TURNS:
                    start, turns = pos, 0
                cum = [0, *np.cumsum(np.array(columns[1][k].as_py(), np.int64)).tolist()]
                rows.append((start, pos, len(own), lcp, ext, cum, columns[2][k].as_py(), columns[3][k].as_py(), columns[4][k].as_py(), part, held.as_py() if last is None else None))
                i, last, turns, edge = i + 1, own, turns + len(own), held
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _LINE, strict=True)], schema=_LINE)
        if edge is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*[None] * 9, part, edge.as_py()), _LINE, strict=True)], schema=_LINE)

    return run


def borders(lined: DataFrame) -> dict[int, tuple[int, int]]:
    """For each partition the turns that its first sequence shares with the last one before, and whether that one leads to it."""
    before = F.lag("digests").over(Window.orderBy("part", F.col("pos").isNull()))
    rows = lined.filter("digests is not null").select("part", "pos", "digests", before.alias("before"))  # two rows a partition
    same = F.zip_with("digests", "before", lambda a, b: F.coalesce(a == b, F.lit(False)))
    shared = let(F.array_position(same, False), lambda p: F.when(p > 0, p - 1).otherwise(F.size(same)))
    found = rows.filter("pos is not null").select("part", F.when(F.col("before").isNull(), -1).otherwise(shared).alias("lcp"), F.size("before").alias("size")).collect()
    return {r.part: (r.lcp, int(r.lcp == r.size)) for r in found}


class Block:
    """A block's sequences in order, as arrays."""

    def __init__(self, table: pa.Table, first: dict[int, tuple[int, int]]) -> None:
        table = table.take(np.argsort(table["pos"].to_numpy()))
        self.pos, self.length, self.lcp, self.ext, self.w, self.conv = (table[c].to_numpy().astype(np.int64) for c in ("pos", "length", "lcp", "ext", "w", "conv"))
        self.id, self.n, self.sha = int(self.pos[0]), len(self.pos), table["sha"]
        if not self.pos[0] & ((1 << 40) - 1):
            self.lcp[0], self.ext[0] = first[int(self.pos[0]) >> 40]
        cum = table["cum"].combine_chunks()
        at, flat = cum.offsets.to_numpy(), cum.values.to_numpy()
        self.cum = lambda i, upto: flat[at[i] : at[i] + max(upto, 1)]
        self.total, self.base = flat[at[1:] - 1], flat[at[:-1] + np.maximum(self.lcp, 0)]
        adds = (self.w, self.w * self.total, self.total - self.base, 1 - self.ext)
        self.before = np.concatenate([np.zeros((4, 1), np.int64), np.cumsum(np.stack(adds), axis=1)], axis=1)
        self._groups()

    def _groups(self) -> None:
        """Positions of one value between the same smaller ones; -1 and n where the block has none smaller."""
        self.gid = np.zeros(self.n, np.int64)
        self.left, self.right, self.count = {}, {}, {}
        stack: list[list[int]] = []  # first and last position of open groups
        for j, v in enumerate(self.lcp.tolist()):
            while stack and self.lcp[stack[-1][0]] > v:
                self.right[stack.pop()[0]] = j
            if stack and self.lcp[stack[-1][0]] == v:
                stack[-1][1] = j
                self.count[stack[-1][0]] += 1
            else:
                self.left[j], self.count[j] = (stack[-1][1] if stack else -1), 1
                stack.append([j, j])
            self.gid[j] = stack[-1][0]
        for f, _ in stack:
            self.right[f] = self.n

    def sums(self, i: int) -> list[int]:
        return self.before[:, i].tolist()


END = f"struct<value: int, pos: long, gid: long, {', '.join(f'{s}: long' for s in SUMS)}, conv: long, base: long, ext: int, length: int, sha: string, k: long>"
SUMMARY = f"block long, n long, first int, low int, k long, conv long, {', '.join(f'{s} long' for s in SUMS)}, lefts array<{END}>, rights array<{END}>"


def _summary(first: dict[int, tuple[int, int]]):
    """Of one block: minimum, sums, and the running minima that other blocks may look up (sums within the block)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL(SUMMARY))

    def run(table: pa.Table) -> pa.Table:
        b = Block(table, first)
        names = ["value", "pos", "gid", *SUMS, "conv", "base", "ext", "length", "sha", "k"]
        entry = lambda i, conv, k: dict(zip(names, (int(b.lcp[i]), int(b.pos[i]), int(b.pos[b.gid[i]]), *b.sums(i), conv, int(b.base[i]), int(b.ext[i]), int(b.length[i]), b.sha[i].as_py(), k), strict=True))
        ahead = np.minimum.accumulate(b.conv)
        behind = np.minimum.accumulate(b.conv[::-1])[::-1]
        least = np.minimum.accumulate(b.lcp)
        rights = [entry(i, int(ahead[i - 1]) if i else None, b.count[i]) for i in np.flatnonzero(np.concatenate([[True], b.lcp[1:] < least[:-1]])).tolist()]
        least = np.minimum.accumulate(b.lcp[::-1])[::-1]
        lefts = [entry(i, int(behind[i]), 0) for i in np.flatnonzero(np.concatenate([b.lcp[:-1] < least[1:], [True]])).tolist()]
        low = int(b.lcp.min())
        row = (b.id, b.n, int(b.lcp[0]), low, int((b.lcp == low).sum()), int(b.conv.min()), *b.sums(b.n), lefts, rights)
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(row, kind, strict=True)], schema=kind)

    return run


class Blocks:
    """What is known of all blocks, in order."""

    def __init__(self, rows: list) -> None:
        rows = sorted(rows, key=lambda r: r.block)
        self.id, self.first, self.low, self.k, self.conv = (np.array([r[c] for r in rows], np.int64) for c in ("block", "first", "low", "k", "conv"))
        self.before = np.concatenate([np.zeros((4, 1), np.int64), np.cumsum(np.array([[r[s] for s in SUMS] for r in rows], np.int64).reshape(-1, 4).T, axis=1)], axis=1)

    def towards(self, at: int, value: int, step: int) -> tuple[int, int | None, int]:
        """From block `at` in a direction: the nearest block with a smaller minimum (-1, or their number, if none), and of those between the smallest id and how often they have the value."""
        found = np.flatnonzero(self.low[:at] < value)[-1:] if step < 0 else at + 1 + np.flatnonzero(self.low[at + 1 :] < value)[:1]
        target = int(found[0]) if len(found) else (-1 if step < 0 else len(self.id))
        between = slice(target + 1, at) if step < 0 else slice(at + 1, target)
        conv = self.conv[between]
        return target, int(conv.min()) if len(conv) else None, int(self.k[between][self.low[between] == value].sum())


_NODE = [
    ("gid", "long"), ("value", "int"), ("leaf", "boolean"), ("canonical", "boolean"), ("conv", "long"), ("k", "long"),
    ("l_block", "long"), *[(f"l_{s}", "long") for s in SUMS], ("base", "long"), ("ext", "int"), ("length", "int"), ("sha", "string"), ("l_value", "int"), ("l_gid", "long"),
    ("r_block", "long"), *[(f"r_{s}", "long") for s in SUMS], ("r_value", "int"), ("r_gid", "long"), ("cum", "array<long>"),
]
NODE = ", ".join(f"{c} {t}" for c, t in _NODE)


def _nodes(first: dict[int, tuple[int, int]], every: Blocks):
    """Of one block: its groups of positions and its leaves, with what the block knows of their intervals' ends.

    l_block, r_block: where an end lies in another block; its sums are left to a join.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL(NODE))

    def run(table: pa.Table) -> pa.Table:
        b = Block(table, first)
        at = int(np.searchsorted(every.id, b.id))
        far = every.before[:, at].tolist()
        sums = lambda i: [x + y for x, y in zip(b.sums(i), far, strict=True)]
        none = [None] * len(SUMS)
        table_of = [b.conv]
        while 2 << (len(table_of) - 1) <= b.n:
            half, last = 1 << (len(table_of) - 1), table_of[-1]
            table_of.append(np.minimum(last[:-half], last[half:]))
        least = lambda i, j: int(min(table_of[(k := (j - i).bit_length() - 1)][i], table_of[k][j - (1 << k)]))
        rows = []
        for f, left in b.left.items():
            v, right = int(b.lcp[f]), b.right[f]
            if v < 0:
                continue
            ids, k, canonical = [least(max(left, 0), right)], b.count[f], True
            if left >= 0:
                ending = int(b.length[left])
                l_part = [None, *sums(left), int(b.base[left]), int(b.ext[left]), ending, b.sha[left].as_py() if ending == v else None, int(b.lcp[left]), int(b.pos[b.gid[left]])]
            else:
                target, conv, others = every.towards(at, v, -1)
                ids.append(conv)
                canonical = not others
                l_part = [int(every.id[target]), *none, *[None] * 6]
            if right < b.n:
                r_part = [None, *sums(right), int(b.lcp[right]), int(b.pos[b.gid[right]])]
            else:
                target, conv, others = every.towards(at, v, 1)
                ids.append(conv)
                k += others
                r_part = [None, *every.before[:, -1].tolist(), -1, None] if target == len(every.id) else [int(every.id[target]), *none, None, None]
            rows.append((int(b.pos[f]), v, False, canonical, min(x for x in ids if x is not None), k, *l_part, *r_part, b.cum(f, v).tolist() if canonical else None))
        following = np.append(b.lcp[1:], every.first[at + 1] if at + 1 < len(every.id) else -1)
        beyond = np.append(b.pos[b.gid[1:]], every.id[at + 1] if at + 1 < len(every.id) else -1)
        for i in np.flatnonzero(b.length > np.maximum(b.lcp, following)).tolist():
            w, size = int(b.w[i]), int(b.length[i])
            left = [None, 0, 0, 0, 0, 0, 0, size, b.sha[i].as_py(), int(b.lcp[i]), int(b.pos[b.gid[i]])]
            rows.append((int(b.pos[i]), size, True, True, int(b.conv[i]), 0, *left, None, w, w * int(b.total[i]), int(b.total[i]), 1, int(following[i]), int(beyond[i]), b.cum(i, size).tolist()))
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kind)], schema=kind)

    return run


def _resolved(nodes: DataFrame, summary: DataFrame, every: Blocks) -> DataFrame:
    """Groups whose interval ends in other blocks, with what those blocks' running minima say."""
    far = summary.sparkSession.createDataFrame([(int(b), *map(int, every.before[:, i])) for i, b in enumerate(every.id)], f"block long, {', '.join(f'f_{s} long' for s in SUMS)}")
    ahead = summary.select("block", "lefts", "rights").join(far, "block")  # a row for each block
    side = lambda c, ends_: ahead.select(F.col("block").alias(f"{c}_block"), F.col(ends_), *[F.col(f"f_{s}").alias(f"{c}f_{s}") for s in SUMS])
    joined = nodes.join(small(side("l", "lefts")), "l_block", "left").join(small(side("r", "rights")), "r_block", "left")
    smaller = lambda c: F.array_max(F.filter(c, lambda e: e["value"] < F.col("value")))
    equal = lambda c: F.filter(c, lambda e: e["value"] == F.col("value"))
    joined = joined.withColumn("le", smaller("lefts")).withColumn("re", smaller("rights")).withColumn("lq", F.coalesce(F.size(equal("lefts")), F.lit(-1)) > 0).withColumn("rq", F.coalesce(F.get(equal("rights"), F.lit(0))["k"], F.lit(0)))
    new = {f"{c}_{s}": F.coalesce(F.col(f"{c}_{s}"), F.col(f"{c}e.{s}") + F.col(f"{c}f_{s}")) for c in "lr" for s in SUMS}
    new |= {c: F.coalesce(F.col(c), F.col(f"le.{c}")) for c in ("base", "ext", "length")}
    new |= {f"{c}_{x}": F.coalesce(F.col(f"{c}_{x}"), F.col(f"{c}e.{x}")) for c in "lr" for x in ("value", "gid")}
    new |= {"sha": F.coalesce("sha", F.when(F.col("le.length") == F.col("value"), F.col("le.sha"))), "canonical": F.col("canonical") & ~F.col("lq"), "conv": F.least("conv", "le.conv", "re.conv"), "k": F.col("k") + F.col("rq")}
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c, _ in _NODE])


def trie(own: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes of the prefix trie of conversations (conv_id, digests, sizes)."""
    with temporary(own.sparkSession):
        rows = stored(own.withColumn("k1", F.xxhash64("digests")).withColumn("k2", F.xxhash64(F.lit(7), "digests")))
        keys = ["k1", "k2"]
        same = rows.groupBy(*keys).agg(F.first("digests").alias("digests"), F.first("sizes").alias("sizes"), F.count("*").alias("w"), F.min("conv_id").alias("conv"))
        distinct = stored(same.join(ends(rows.select(*keys, "conv_id")), keys).select("digests", "sizes", "w", "conv", "sha"))
        lined = stored(distinct.repartitionByRange("digests").sortWithinPartitions("digests").mapInArrow(_lines(block), LINE))
        first = borders(lined)
        blocks = lined.filter("pos is not null").drop("digests", "part").groupBy("block")
        summary = stored(blocks.applyInArrow(_summary(first), SUMMARY))
        every = Blocks(summary.drop("lefts", "rights").collect())
        nodes = stored(blocks.applyInArrow(_nodes(first, every), NODE))
        open_ = F.col("l_block").isNotNull() | F.col("r_block").isNotNull()
        nodes = stored(nodes.filter(~open_).unionAll(_resolved(nodes.filter(open_), summary, every)))
        by_left = F.col("l_value") >= F.col("r_value")
        own_nodes = nodes.filter("canonical").withColumn("above", F.greatest("l_value", "r_value")).withColumn("parent", F.when(F.col("above") >= 0, F.when(by_left, F.col("l_gid")).otherwise(F.col("r_gid"))))
        parents = nodes.filter("not leaf").select(F.col("gid").alias("parent"), F.col("conv").alias("parent_conv"))
        sums = {s: F.col(f"r_{s}") - F.col(f"l_{s}") for s in SUMS}
        told = own_nodes.join(parents, "parent", "left").select(
            "conv", "parent_conv", "above", "value", "cum", "sha", sums["ws"].alias("n_convs"), (sums["x"] + F.col("ext")).alias("n_leaves"),
            F.when(F.col("leaf"), 0).otherwise(F.col("k") + 1 - (F.col("length") == F.col("value")).cast("int")).cast("long").alias("k"),
            (sums["wt"] - sums["e"] - F.col("base")).alias("all_saved"), F.explode(F.sequence(F.col("above") + 1, F.col("value"))).alias("depth"),
        )
        deepest = F.col("depth") == F.col("value")
        return lasting(told.select(
            F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"),
            F.when(F.col("depth") == 0, None).when(F.col("depth") == F.col("above") + 1, F.col("parent_conv")).otherwise(F.col("conv")).alias("parent_conv_id"),
            "n_convs", F.when(deepest, F.col("k")).otherwise(1).cast("long").alias("n_children"), "n_leaves",
            (F.col("all_saved") - (F.col("n_convs") - 1) * F.get("cum", F.greatest(F.col("depth") - 1, F.lit(0)))).alias("saved_tokens"),
            F.when(deepest, F.coalesce("sha", F.lit(NOTHING))).otherwise(NOTHING).alias("ends_sha256"),
        ))


def report(conversations: DataFrame) -> DataFrame:
    """The trie of conversations rebuilt on their fifth ones' first turns."""
    with temporary(conversations.sparkSession):
        return trie(rebuilt(sequences(conversations.select("conv_id", "turn", "role", "text"))))
