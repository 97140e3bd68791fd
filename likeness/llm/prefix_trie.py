"""A trie of conversation prefixes, merged family by family.

A family is a base conversation with those that may begin with its turns. Each
family becomes a small trie in one task; only the nodes of these tries, without
any text, are shuffled to be merged into the global one. Sums over subtrees go
back the same way: every global node is owned by the family of its smallest
member, families add up what they own below each of their nodes, and the parts of
a node are added. Families beyond ``LARGE`` turns never meet in one task: their
conversations are ranked, keyed and summed in blocks instead.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from likeness.llm.quality_rules import WORD
from likeness.runtime import cut, ship

FAMILY = 20  # ids of a family, from a multiple of this on
SHARED = 4  # a conversation begins with fewer than so many of its base's turns
LARGE = 50_000  # turns of a family that one task holds
BLOCK = 4096  # turns of a long conversation that a running sum takes at a time
SPAN = 20_480  # ids whose members of one node are joined to one piece of text
ROOT = bytes(32)

NODES = "family long, key binary, parent binary, depth long, words long, n long, least long, inner boolean, ends array<long>"
SUMS = "key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
GLOBAL = ["n_convs", "conv_id", "leaf", "cost"]


def shared(conv_id: int) -> int:
    """Turns that a conversation takes from its base."""
    return zlib.crc32(str(conv_id).encode()) % SHARED


def _base(conv_id: Column) -> Column:
    return conv_id - conv_id % FAMILY


def _mixed(turn_key: bytes, depth: int) -> int:
    return int.from_bytes(hashlib.sha256(turn_key + depth.to_bytes(8, "big")).digest(), "big")


def family_trie(own: pa.Table, heads: pa.Table) -> pa.Table:
    """The trie of one family. A node's key is the exclusive or of its turns' digests, each with its depth; so long conversations can be keyed in blocks."""
    if not own.num_rows:
        return pa.Table.from_pylist([], schema=_schema(NODES))
    family = own["family"][0].as_py()
    begin = sorted(zip(heads["rank"].to_pylist(), heads["turn_key"].to_pylist(), heads["words"].to_pylist()))
    begin = [x[1:] for x in begin]
    convs: dict[int, list] = {}
    for c, *turn in sorted(zip(*(own[k].to_pylist() for k in ("conv_id", "rank", "turn_key", "words")))):
        convs.setdefault(c, []).append(turn)
    key, parent, depth, words, n, least, inner, ends = [0], [-1], [0], [0], [0], [min(convs)], [False], [[]]
    child: dict[tuple[int, bytes], int] = {}
    for c in sorted(convs):
        h, at = shared(c), 0
        n[0] += 1
        for d, (turn, w) in enumerate(begin[:h] + [t[1:] for t in convs[c] if t[0] > h], 1):
            to = child.get((at, turn))
            if to is None:
                to = child[at, turn] = len(key)
                inner[at] = True
                for column, value in zip((key, parent, depth, words, n, least, inner, ends), (key[at] ^ _mixed(turn, d), at, d, w, 0, c, False, [])):
                    column.append(value)
            at = to
            n[at] += 1
        ends[at].append(c)
    digest = [k.to_bytes(32, "big") for k in key]
    return pa.Table.from_arrays([pa.array(x, t.type) for x, t in zip(([family] * len(key), digest, [digest[p] if p >= 0 else None for p in parent], depth, words, n, least, inner, ends), _schema(NODES))], schema=_schema(NODES))


def family_sums(nodes: pa.Table) -> pa.Table:
    """What a family adds to the sums of each of its nodes, from the global facts of the nodes that it owns."""
    rows = nodes.sort_by([("depth", "descending")]).to_pylist()
    by_key = {r["key"]: r for r in rows}
    for r in rows:
        r["children"] = r["leaves"] = r["saved"] = 0
    for r in rows:  # the deepest first
        r["leaves"] += r["own"] and r["leaf"]
        r["saved"] += r["own"] * r["cost"]
        up = by_key.get(r["parent"])
        if up:
            up["children"] += r["own"]
            up["leaves"] += r["leaves"]
            up["saved"] += r["saved"]
    over = lambda r: by_key[r["parent"]]["conv_id"] if r["parent"] else None
    return pa.Table.from_pylist([dict(key=r["key"], conv_id=r["conv_id"], depth=r["depth"], parent_conv_id=over(r), n_convs=r["n_convs"], n_children=r["children"], n_leaves=int(r["leaves"]), saved_tokens=r["saved"]) for r in rows], schema=_schema(SUMS))


def _schema(ddl: str) -> pa.Schema:
    types = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, types[t]) for n, t in (x.split() for x in ddl.split(", "))])


def _turns(conversations: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role"), text("text"))
    return rows.withColumn("family", _base(F.col("conv_id")))


def _said() -> list[Column]:
    """A turn without its text: a digest of role and text, and the number of words."""
    whole = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    return [F.unhex(F.sha2(whole, 256)).alias("turn_key"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")]


IN_ORDER = [F.asc_nulls_first, F.asc, F.asc]


def _order() -> list[Column]:
    return [f(c) for f, c in zip(IN_ORDER, ("turn", "role", "text"))]


def _families(turns: DataFrame) -> DataFrame:
    """Nodes of the tries of families, each built in one task."""
    w = Window.partitionBy("family", "conv_id").orderBy(*_order())
    ranked = lambda rows: rows.repartition("family").withColumn("rank", F.row_number().over(w).cast("long")).select("family", "conv_id", "rank", *_said())
    heads = ranked(turns.where("conv_id = family")).where(F.col("rank") < SHARED)
    heads = heads.select(F.col("family").alias("base"), "rank", "turn_key", "words")
    return ranked(turns).groupBy("family").cogroup(heads.groupBy("base")).applyInArrow(family_trie, NODES)


def _running(rows: DataFrame, add, names: list[str], back: bool = False) -> DataFrame:
    """Running values of ``names`` along each conversation by ``depth``, in two levels: over blocks, then in a block."""
    cut_up = rows.withColumn("block", F.floor(F.col("depth") / BLOCK))
    whole = cut_up.groupBy("conv_id", "block").agg(*[add(n).alias(f"_{n}") for n in names])
    order = F.desc if back else F.asc
    before = Window.partitionBy("conv_id").orderBy(order("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("conv_id", "block", *[F.coalesce(add(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in names])
    inside = Window.partitionBy("conv_id", "block").orderBy(order("depth")).rowsBetween(Window.unboundedPreceding, 0)
    out = cut_up.join(whole, ["conv_id", "block"])
    both = lambda n: F.col(f"_{n}").bitwiseXOR(add(n).over(inside)) if add is F.bit_xor else F.col(f"_{n}") + add(n).over(inside)
    return out.select(*rows.columns, *[both(n).alias(f"all_{n}") for n in names])


def _chains(turns: DataFrame) -> DataFrame:
    """The same nodes with a conversation as its own family, for families too large for a task: no step holds more than a block of a conversation."""
    tasks = max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    spread = turns.withColumn("salt", F.rand(7)).repartitionByRange(tasks, "conv_id", *_order(), "salt").sortWithinPartitions("conv_id", *_order())
    placed = cut(spread.select("family", "conv_id", *_said(), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("conv_id", "part").count().select("conv_id", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("conv_id", "part").orderBy("place")
    ranked = placed.join(counts, ["conv_id", "part"]).withColumn("rank", F.col("earlier") + F.row_number().over(inside))
    ranked = cut(ranked.select("family", "conv_id", "rank", "turn_key", "words"))
    heads = ranked.where((F.col("conv_id") == F.col("family")) & (F.col("rank") < SHARED)).select("family", F.struct("rank", "turn_key", "words").alias("head"))
    heads = heads.groupBy("family").agg(F.array_sort(F.collect_list("head")).alias("heads"))  # at most three
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(SHARED))
    convs = ranked.groupBy("family", "conv_id").agg(F.max("rank").alias("turns")).join(heads, "family", "left").withColumn("heads", F.coalesce("heads", F.array().cast("array<struct<rank:bigint,turn_key:binary,words:bigint>>")))
    convs = convs.select("conv_id", h.alias("h"), "heads", F.least(h, F.size("heads").cast("long")).alias("taken"), "turns")
    convs = cut(convs.withColumn("length", F.col("taken") + F.greatest(F.col("turns") - F.col("h"), F.lit(0))))
    first = convs.select("conv_id", "length", "taken", F.explode("heads").alias("t")).where("t.rank <= taken").select("conv_id", "length", F.col("t.rank").alias("depth"), "t.turn_key", "t.words")
    own = ranked.join(convs.select("conv_id", "h", "taken", "length"), "conv_id").where("rank > h").select("conv_id", "length", (F.col("rank") - F.col("h") + F.col("taken")).alias("depth"), "turn_key", "words")
    said = first.unionByName(own)
    mixed = F.sha2(F.concat("turn_key", F.unhex(F.lpad(F.hex("depth"), 16, "0"))), 256)
    lanes = [f"x{i}" for i in range(4)]
    lane = lambda i: F.conv(F.substring("mixed", 16 * i + 1, 16), 16, -10).cast("long")
    keyed = _running(said.withColumn("mixed", mixed).select("conv_id", "length", "depth", "words", *[lane(i).alias(x) for i, x in enumerate(lanes)]), F.bit_xor, lanes)
    binary = lambda cs: F.unhex(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in cs]))
    ends = F.when(F.col("depth") == F.col("length"), F.array("conv_id")).otherwise(F.array().cast("array<bigint>"))
    rest = lambda: ["depth", "words", F.lit(1).cast("long").alias("n"), F.col("conv_id").alias("least"), (F.col("depth") < F.col("length")).alias("inner"), ends.alias("ends")]
    below = keyed.select(F.col("conv_id").alias("family"), binary([F.col(f"all_{x}") for x in lanes]).alias("key"), binary([F.col(f"all_{x}").bitwiseXOR(F.col(x)) for x in lanes]).alias("parent"), *rest())
    zero = F.lit(0).cast("long")
    tops = convs.withColumns({"depth": zero, "words": zero}).select(F.col("conv_id").alias("family"), F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("parent"), *rest())
    return below.unionByName(tops)


def _chain_sums(nodes: DataFrame, merged: DataFrame) -> DataFrame:
    """``family_sums`` for conversations that are their own families; what a node adds to its parent is a row of its own."""
    met = nodes.select(F.col("family").alias("conv"), "key", "parent", "depth").join(merged.select("key", *GLOBAL), "key")
    owned = (F.col("conv_id") == F.col("conv")).cast("long")
    met = met.select("key", "parent", "depth", F.col("conv_id").alias("first"), F.col("conv").alias("conv_id"), "n_convs", owned.alias("own"), (owned * F.col("leaf").cast("long")).alias("leaves"), (owned * F.col("cost")).alias("saved"))
    met = cut(_running(met, F.sum, ["leaves", "saved"], back=True))
    over = merged.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    sums = met.join(over, "parent", "left").select("key", F.col("first").alias("conv_id"), "depth", "parent_conv_id", "n_convs", zero.alias("n_children"), F.col("all_leaves").alias("n_leaves"), F.col("all_saved").alias("saved_tokens"))
    up = met.where("parent IS NOT NULL").select(F.col("parent").alias("key"), none.alias("conv_id"), none.alias("depth"), none.alias("parent_conv_id"), none.alias("n_convs"), F.col("own").alias("n_children"), zero.alias("n_leaves"), zero.alias("saved_tokens"))
    return sums.unionByName(up)


def _ends(nodes: DataFrame) -> DataFrame:
    """A digest for each node of the ids that end there, ascending. Pieces of ``SPAN`` ids are joined first; a task then reads the pieces of a node one after another."""
    ids = nodes.select("key", F.explode("ends").alias("id"))
    pieces = ids.groupBy("key", F.floor(F.col("id") / SPAN).alias("piece")).agg(F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ",").alias("ids"))
    pieces = pieces.repartition("key").sortWithinPartitions("key", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in batches:
            done: list[tuple[bytes, str]] = []
            for key, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if key != now:
                    if now is not None:
                        done.append((now, state.hexdigest()))
                    now, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _digests(done)
        if now is not None:
            yield _digests([(now, state.hexdigest())])

    return pieces.select("key", "ids").mapInArrow(run, "key binary, ends_sha256 string")


def _digests(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["key", "ends_sha256"])


def trie(conversations: DataFrame, large: int = LARGE) -> DataFrame:
    """One row for each node of the trie of all rebuilt conversations, the root included.

    Rows without an id take no part. A null turn comes first; rows of one turn
    follow by role, then by text; rows that repeat each other are turns of their
    own. A null role or text is empty. An empty table has no nodes. Only
    ``conv_id``, ``turn``, ``role`` and ``text`` are read. ``large`` is the number
    of turns beyond which a family is not built in one task.
    """
    ship(conversations.sparkSession)
    turns = _turns(conversations)
    crowded = cut(turns.groupBy("family").count().where(F.col("count") > large).select("family"))
    some = not crowded.isEmpty()
    small = cut(_families(turns.join(crowded, "family", "left_anti") if some else turns))
    long = cut(_chains(turns.join(crowded, "family", "left_semi"))) if some else None
    nodes = small.unionByName(long) if some else small
    merged = nodes.groupBy("key").agg(F.sum("n").alias("n_convs"), F.min("least").alias("conv_id"), F.max("inner").alias("inner"), F.max("words").alias("words"))
    merged = cut(merged.select("key", "n_convs", "conv_id", (~F.col("inner")).alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("cost")))
    met = small.select("family", "key", "parent", "depth").join(merged.select("key", *GLOBAL), "key")
    # A conversation of a large family has an id of no small family, so owners are told apart by the family of the smallest member.
    met = met.withColumn("own", F.col("family") == _base(F.col("conv_id")))
    parts = met.groupBy("family").applyInArrow(family_sums, SUMS)
    if some:
        parts = parts.unionByName(_chain_sums(long, merged))
    most, total = ["conv_id", "depth", "parent_conv_id", "n_convs"], ["n_children", "n_leaves", "saved_tokens"]
    out = parts.groupBy("key").agg(*[F.max(c).alias(c) for c in most], *[F.sum(c).alias(c) for c in total]).join(_ends(nodes), "key", "left")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))


SQL = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS r,
         {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS said
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list(said ORDER BY r) AS turns,
         list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
           lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(0 AS BIGINT) FOR k IN range(8)]), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) AS c
  FROM t GROUP BY conv_id
), rebuilt AS (
  SELECT o.conv_id, list_concat(coalesce(b.turns[:h], []), o.turns[h + 1:]) AS turns
  FROM (SELECT *, xor(c, 4294967295) % 4 AS h FROM own) o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20
), members AS (
  SELECT conv_id, d, turns[:d] AS path, turns[:d - 1] AS over, len(turns) = d AS ends, turns[d].text AS last
  FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT path, CASE WHEN d = 0 THEN NULL ELSE any_value(over) END AS over, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(any_value(last), '[^\x20\x09-\x0D]+')) END AS cost,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM members GROUP BY path, d
), kids AS (SELECT over AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY over),
facts AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.path = n.path),
sums AS (
  SELECT p AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(cost) AS saved
  FROM (SELECT n_children, cost, unnest([path[:e] FOR e IN range(0, depth + 1)]) AS p FROM facts) GROUP BY p
)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, o.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
       CAST(s.saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM facts f LEFT JOIN nodes o ON o.path = f.over LEFT JOIN sums s ON s.path = f.path
"""
