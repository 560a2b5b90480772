"""Prefix trie of conversations with vertical bitmaps.

A turn is known by the 128-bit digest of its role and text; texts never move.  The
conversations of a shard (a range of ids) are numbered, and an index gives for each
``(position, turn)`` the bitset of those that have it there.  A depth-first walk from
the bitset of all takes the turn of a node's lowest conversation at the next position,
intersects the node's bitset with that posting, which is a child, and goes on with what
is left; conversations without a further turn make the node's end list.

Shards see parts of a node, so nodes are put together by the digest of their path.  All
numbers of a subtree become sums over members, which shards add up on their own: a node
belongs to its smallest member, and the nodes of one conversation's path that belong to
it are the deepest ones.  Once each conversation's first own depth is known (from the
smallest members of all nodes), ``(members - 1) x length`` over a subtree is the length
of the last turns of all members at the depths before their own, and the childless nodes
of a subtree are its members that end on an own, childless node.

A node of which very many conversations are members is one row per shard.  A conversation
of very many turns is cut into segments: a shard's walk of a segment begins at the digests
of the paths that lead to it, which the segments' own digests give when folded in order.
"""
from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_by_share

#: Ids in a shard's range.
SHARD = 1000
#: Turns in a segment of a conversation, and turn numbers that are ordered together.
SEGMENT = 4096
#: Path digest of the root.
ROOT = hashlib.md5(b"").digest()


def turns(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
          text_col: str = "text") -> DataFrame:
    """``(c, pos, turn, n)``: every turn's place in its conversation (from 0), digest and code points.

    Turns go by ``turn_col``, nulls first, equal numbers by their digest.  A null role or
    text counts as empty.  Rows without an id belong to no conversation and are left out.
    Other columns are not read."""
    role, text = (F.coalesce(F.col(x), F.lit("")) for x in (role_col, text_col))
    # turns are ordered in blocks of numbers, so that one very long conversation is not one task
    block = F.coalesce(F.expr(f"`{turn_col}` div {SEGMENT}"), F.lit(-1 << 60))
    rows = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("c"), F.col(turn_col).alias("t"), block.alias("b"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("turn"), F.length(text).alias("n"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("c", "b").orderBy(F.col("t").asc_nulls_first(), "turn")))
    before = Window.partitionBy("c").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("c", "b").agg(F.count(F.lit(1)).alias("m"))
    offsets = counts.select("c", "b", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("offset"))
    return rows.join(offsets, ["c", "b"]).select("c", (F.col("offset") + F.col("place") - 1).alias("pos"), "turn", "n")


def rebuilt(rows: DataFrame, heads: int = 6, family: int = 100) -> tuple[DataFrame, DataFrame]:
    """``(conversations, turns)`` where conversation ``c`` begins with the first ``h`` turns of
    conversation ``c - c % family`` (all if it has fewer) and goes on with its own after its
    first ``h``; ``h`` is the unsigned crc32 of the decimal ``c`` modulo ``heads``.

    A conversation left without turns is in the first table only."""
    h = (F.crc32(F.col("c").cast("string")) % heads).cast("int")
    convs = rows.groupBy("c").agg(F.count(F.lit(1)).alias("n_own")).select(
        "c", h.alias("h"), (F.col("c") - F.col("c") % family).alias("base"), "n_own")
    first = convs.select(F.col("c").alias("base"), F.col("n_own").alias("n_base"))
    convs = convs.join(first, "base", "left").select("c", "h", "base", F.least("h", F.coalesce("n_base", F.lit(0))).cast("int").alias("taken"), "n_own")
    head = rows.where((F.col("pos") < heads - 1) & (F.col("c") % family == 0)).withColumnRenamed("c", "base")
    lent = convs.drop("n_own").join(head, "base").where(F.col("pos") < F.col("h")).select("c", "pos", "turn", "n")
    total = rows.count()
    own = join_by_share(rows, convs.select("c", "h", "taken", "n_own"), ["c"], "n_own", total).where(F.col("pos") >= F.col("h")).select(
        "c", (F.col("taken") + F.col("pos") - F.col("h")).alias("pos"), "turn", "n")
    return convs.select("c"), lent.unionAll(own)


#: Kinds of rows that a shard's segment gets: a conversation, one of its turns, the path that leads
#: to its segment, that it goes on after the segment, its first own depth and whether it ends on a
#: leaf of its own, the sum of what it saves after the segment.
CONV, TURN, START, MORE, OWN, TAIL = range(6)


class _Shard:
    """Bitsets of one segment of one shard: conversation ``j`` (in ascending order of ids) is bit ``j``."""

    def __init__(self, table: pa.Table, segment: int):
        seen: dict[int, list] = {}
        known: dict[int, dict] = {k: {} for k in (START, MORE, OWN, TAIL)}
        cols = table.to_pydict()
        for kind, c, pos, turn, n, flag in zip(*(cols[x] for x in ("kind", "c", "pos", "turn", "n", "flag")), strict=True):
            if kind in (CONV, TURN):
                path = seen.setdefault(c, [])
                if kind == TURN:
                    path.append((pos, turn, n))
            else:
                known[kind][c] = (pos, turn, n, flag)
        self.first = cols["seg"][0] * segment
        self.segment = segment
        self.ids = sorted(seen)
        self.paths = [[(turn, n) for _, turn, n in sorted(seen[c])] for c in self.ids]
        deepest = max(map(len, self.paths), default=0)
        self.posting: dict[tuple, int] = {}
        self.goes_on = [0] * (deepest + 1)
        self.late = [0] * (deepest + 2)          # conversations whose own nodes begin below this depth
        self.leaf = self.more = 0
        self.tail = [0] * len(self.ids)
        self.roots: dict[bytes, int] = {}
        for j, (c, path) in enumerate(zip(self.ids, self.paths, strict=True)):
            bit = 1 << j
            for pos, (turn, _) in enumerate(path):
                self.posting[pos, turn] = self.posting.get((pos, turn), 0) | bit
                self.goes_on[pos] |= bit
            start = known[START][c][1] if c in known[START] else ROOT
            self.roots[start] = self.roots.get(start, 0) | bit
            self.more |= bit if c in known[MORE] else 0
            depth, _, _, leaf = known[OWN].get(c, (self.first + deepest + 2, None, None, False))
            depth = min(depth - self.first, deepest + 2)
            if depth > 0:
                self.late[depth - 1] |= bit
            self.leaf |= bit if leaf else 0
            self.tail[j] = known[TAIL][c][2] if c in known[TAIL] else 0
        for d in range(deepest, -1, -1):
            self.late[d] |= self.late[d + 1]

    def walk(self):
        """Every node, parents first: (parent's number, path digest, parent's digest, depth in the segment,
        bitset, end bitset, length of the last text).  A later segment's roots come along without
        a parent, but are nodes of the segment before."""
        stack = [(-1, key, None, 0, bits, 0) for key, bits in sorted(self.roots.items())]
        number = 0
        while stack:
            parent, key, parent_key, depth, bits, length = stack.pop()
            left = bits & self.goes_on[depth]
            yield parent, key, parent_key, depth, bits, bits & ~left & ~(self.more if depth == self.segment else 0), length
            while left:
                j = (left & -left).bit_length() - 1
                turn, n = self.paths[j][depth]
                child = bits & self.posting[depth, turn]
                left &= ~child
                below = hashlib.md5(key + turn).digest()
                if depth + 1 == self.segment:
                    below = _after(self.roots_of(j), hashlib.md5(b"".join(t for t, _ in self.paths[j])).digest())
                stack.append((number, below, key, depth + 1, child, n))
            number += 1

    def roots_of(self, j: int) -> bytes:
        return next(key for key, bits in self.roots.items() if bits >> j & 1)

    def nodes(self):
        """The walk without a later segment's roots, whose numbers stay."""
        return [(i, *node) for i, node in enumerate(self.walk()) if node[0] >= 0 or not self.first]

    def lowest(self, bits: int) -> int:
        return self.ids[(bits & -bits).bit_length() - 1]

    def members(self, bits: int) -> str:
        return ",".join(str(self.ids[j]) for j in self.numbers(bits))

    @staticmethod
    def numbers(bits: int):
        while bits:
            yield (bits & -bits).bit_length() - 1
            bits &= bits - 1


def _after(start: bytes, segment: bytes) -> bytes:
    """Path digest after a whole segment."""
    return hashlib.md5(b"segment" + start + segment).digest()


_NODE = "key binary, parent binary, depth long, low long"
_PART = _NODE + ", n_convs long, n_leaves long, saved long, first_end long, ends string"


def _nodes(segment: int):
    def run(table: pa.Table) -> pa.Table:
        shard = _Shard(table, segment)
        rows = [(key, up, shard.first + depth, shard.lowest(bits)) for _, _, key, up, depth, bits, _, _ in shard.nodes()]
        return _table(rows, ((pa.binary(), "key"), (pa.binary(), "parent"), (pa.int64(), "depth"), (pa.int64(), "low")))
    return run


def _parts(segment: int):
    def run(table: pa.Table) -> pa.Table:
        shard = _Shard(table, segment)
        walk = list(shard.walk())
        saved = [length * (bits & shard.late[depth]).bit_count() for _, _, _, depth, bits, _, length in walk]
        for i in range(len(walk) - 1, -1, -1):
            parent, _, _, depth, bits, _, _ = walk[i]
            if depth == segment:
                saved[i] += sum(shard.tail[j] for j in shard.numbers(bits & shard.more))
            if parent >= 0:
                saved[parent] += saved[i]
        rows = [(key, up, shard.first + depth, shard.lowest(bits), bits.bit_count(), (bits & shard.leaf).bit_count(), saved[i],
                 shard.lowest(ends) if ends else None, shard.members(ends) if ends else None)
                for i, _, key, up, depth, bits, ends, _ in shard.nodes()]
        long = pa.int64()
        return _table(rows, ((pa.binary(), "key"), (pa.binary(), "parent"), (long, "depth"), (long, "low"), (long, "n_convs"), (long, "n_leaves"),
                             (long, "saved"), (long, "first_end"), (pa.string(), "ends")))
    return run


def _segment_digests(table: pa.Table) -> pa.Table:
    """One segment of one conversation: digest of its turns and their number."""
    rows = sorted(zip(table["pos"].to_pylist(), table["turn"].to_pylist(), strict=True))
    digest = hashlib.md5(b"".join(t for _, t in rows)).digest()
    return _table([(table["c"][0].as_py(), table["seg"][0].as_py(), digest, len(rows))],
                  ((pa.int64(), "c"), (pa.int64(), "seg"), (pa.binary(), "turn"), (pa.int64(), "n")))


def _starts(table: pa.Table) -> pa.Table:
    """One conversation's segments in order: what path leads to each, and which are gone on from."""
    rows = sorted(zip(*(table[c].to_pylist() for c in ("seg", "turn", "c")), strict=True))
    start, out = ROOT, []
    for (seg, digest, c), after in zip(rows, [*rows[1:], None], strict=True):
        if seg:
            out.append((c, seg, START, start))
        if after:
            out.append((c, seg, MORE, None))
        start = _after(start, digest)
    return _table(out, ((pa.int64(), "c"), (pa.int64(), "seg"), (pa.int32(), "kind"), (pa.binary(), "turn")))


def _table(rows: list[tuple], fields) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.table({name: pa.array(col, kind) for col, (kind, name) in zip(cols, fields, strict=True)})


def _digests(batches):
    """SHA-256 of each key's end lists, which arrive in order; one list may span many batches."""
    now, sha = None, None
    for batch in batches:
        keys, out = batch.column(0).to_pylist(), []
        for key, part in zip(keys, batch.column(1).to_pylist(), strict=True):
            if key != now:
                if now is not None:
                    out.append((now, sha.hexdigest()))
                now, sha = key, hashlib.sha256(part.encode())
            else:
                sha.update(b"," + part.encode())
        yield from _pairs(out)
    if now is not None:
        yield from _pairs([(now, sha.hexdigest())])


def _pairs(out):
    yield from _table(out, ((pa.binary(), "key"), (pa.string(), "ends_sha256"))).to_batches()


def prefix_trie(conversations: DataFrame, turn_rows: DataFrame) -> DataFrame:
    """One row per node of the trie of all ``conversations (c)``, whose turns are
    ``turn_rows (c, pos, turn, n)`` with ``pos`` from 0 without gaps.

    ``conv_id`` is the smallest member, ``depth`` 0 for the root, ``parent_conv_id`` the
    parent's ``conv_id`` (root: null), then ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` and ``ends_sha256`` (see the module); ``path`` is the node's digest and
    ``parent_path`` its parent's.  Conversations without turns are members of the root and
    end there.  An empty table has no nodes.  Repeated ids are one conversation."""
    def typed(df: DataFrame, kind, **given) -> DataFrame:
        """Rows of one kind for the segments of shards."""
        kinds = {"pos": "long", "turn": "binary", "n": "long", "flag": "boolean"}
        rest = [given.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]
        return df.select(F.expr(f"c div {SHARD}").alias("shard"), given.get("seg", F.lit(0)).cast("long").alias("seg"), "c",
                         (F.lit(kind) if isinstance(kind, int) else kind).cast("int").alias("kind"), *rest)
    seg = F.expr(f"pos div {SEGMENT}")
    rows = (typed(turn_rows, TURN, seg=seg, pos=F.col("pos"), turn=F.col("turn"), n=F.col("n"))
            .unionAll(typed(conversations.select("c").distinct(), CONV)))
    by = ["shard", "seg"]
    rows = cut(rows.repartition(*by))
    # conversations of more than a segment: at most one for every SEGMENT turns
    long = rows.where(f"kind = {TURN} and seg > 0").select("c").distinct()
    is_long = not long.isEmpty()
    if is_long:
        long = F.broadcast(cut(long))
        digests = cut(rows.where(f"kind = {TURN}").join(long, "c").select("c", "seg", "pos", "turn").groupBy("c", "seg")
                      .applyInArrow(_segment_digests, "c long, seg long, turn binary, n long"))
        starts = digests.groupBy("c").applyInArrow(_starts, "c long, seg long, kind int, turn binary")
        rows = cut(rows.unionAll(typed(starts, F.col("kind"), seg=F.col("seg"), turn=F.col("turn"))).repartition(*by))
    nodes = cut(rows.groupBy(*by).applyInArrow(_nodes(SEGMENT), _NODE).groupBy("key").agg(
        F.first("parent").alias("parent"), F.min("depth").alias("depth"), F.min("low").alias("low")))
    kids = cut(nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children")))
    own = (nodes.join(kids, "key", "left").groupBy(F.col("low").alias("c"))
           .agg(F.min("depth").alias("depth"), F.max(F.col("n_children").isNull()).alias("leaf")))
    told = rows.unionAll(typed(own, OWN, pos=F.col("depth"), flag=F.col("leaf")))
    if is_long:
        known = F.broadcast(cut(own.join(long, "c")))
        later = digests.where("seg > 0").select("c", "seg").join(known, "c")
        told = told.unionAll(typed(later, OWN, seg=F.col("seg"), pos=F.col("depth"), flag=F.col("leaf")))
        # what a conversation saves in a segment, and after it
        turn_of = rows.where(f"kind = {TURN}").join(long, "c").join(known.select("c", "depth"), "c", "left")
        saves = turn_of.groupBy("c", "seg").agg(F.sum(F.when(F.col("depth").isNull() | (F.col("pos") + 1 < F.col("depth")), F.col("n")).otherwise(0)).alias("m"))
        after = Window.partitionBy("c").orderBy("seg").rowsBetween(1, Window.unboundedFollowing)
        tails = saves.select("c", "seg", F.coalesce(F.sum("m").over(after), F.lit(0)).alias("m"))
        told = told.unionAll(typed(tails, TAIL, seg=F.col("seg"), n=F.col("m")))
    parts = cut(told.groupBy(*by).applyInArrow(_parts(SEGMENT), _PART))
    whole = parts.groupBy("key").agg(F.first("parent").alias("parent"), F.min("depth").alias("depth"), F.min("low").alias("conv_id"),
                                     *[F.sum(c).alias(c) for c in ("n_convs", "n_leaves", "saved")])
    ends = (parts.where("ends is not null").select("key", "ends", "first_end").repartition("key").sortWithinPartitions("key", "first_end")
            .select("key", "ends").mapInArrow(_digests, "key binary, ends_sha256 string"))
    above = nodes.select(F.col("key").alias("parent"), F.col("low").alias("parent_conv_id"))
    return (whole.join(kids, "key", "left").join(ends, "key", "left").join(above, "parent", "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
                    "n_leaves", F.col("saved").alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
                    F.lower(F.hex("key")).alias("path"), F.lower(F.hex("parent")).alias("parent_path")))


def shared_prefixes(conversations: DataFrame, **names) -> DataFrame:
    """``prefix_trie`` of the rebuilt ``conversations`` (see ``rebuilt``; ``names`` as in ``turns``)."""
    rows = cut(turns(conversations, **names))
    return prefix_trie(*rebuilt(rows))
