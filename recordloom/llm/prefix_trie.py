"""Conversation prefix trie by composable monoid fingerprints.

Conversations are rebuilt from stored turns: a head of the base conversation's
first turns, then the own turns after as many. Neither rebuilt conversations
nor texts are ever materialised. A sequence of turns is an element (hash,
power) of the monoid of polynomial hashes modulo the prime 2^127 - 1; the
product of two elements is the element of the joined sequences. So

* prefix products of all stored turns come from one distributed scan: tasks
  scan sorted ranges of turns, and the product of what a conversation has in
  earlier ranges (one element a task) is multiplied in from the left, so one
  very long conversation is spread over tasks like any other rows;
* the fingerprint of a rebuilt prefix is the product of the base's head and
  a stretch of the own turns, both known from the scan.

Rebuilt prefixes with the same depth and fingerprint are one node. Groups are
verified: all members of a node must agree in the parent's fingerprint and in
the turn that their stored reference (conversation, place) names, and turns of
one content key must be equal texts; so, by induction over the depth, members
of a node are equal. If anything disagrees, all is done again with other hashes.

Sums over subtrees need no walk over levels: a node's members are the ends of
paths through it, so leaves and saved tokens are sums over its members of
values known per conversation (see ``_sums``).

Defined cases: rows without a conversation id belong to no conversation; null
turns come first; rows of one conversation and turn come in the order of a
128-bit hash of role and text; an absent base gives an empty head; an empty
table has no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PRIME = (1 << 127) - 1
BASES = (0x5851F42D4C957F2D14057B7EF767814F, 0x2545F4914F6CDD1D9E3779B97F4A7C15, 0x369DEA0F31A53F85106689D45497FDB5)
GROUP = 20          # conversations that share a base
HEADS = 4           # a head has fewer turns than this
CHUNK_IDS = 4096    # ids of one chunk of an id list
_MASK = (1 << 64) - 1


def _join(hi: int, lo: int) -> int:
    return (hi & _MASK) << 64 | lo & _MASK


def _split(x: int) -> tuple[int, int]:
    hi, lo = x >> 64, x & _MASK
    return hi, lo - (1 << 64) if lo >> 63 else lo


def turn_element(key_a: int, key_b: int) -> int:
    """The hash of a sequence of one turn."""
    return _join(key_a, key_b) % (PRIME - 1) + 1


def product(left: int, right: int, right_turns: int, base: int) -> int:
    """Hash of two joined sequences, the second one of so many turns."""
    return (left * pow(base, right_turns, PRIME) + right) % PRIME


# ---- stored turns --------------------------------------------------------------

_KEYS = "key_a long, key_b long, words long"
_SCAN = f"part int, conv_id long, n long, pa long, pb long, upto long, {_KEYS}"
_PREFIX = f"conv_id long, place long, fa long, fb long, ga long, gb long, upto long, {_KEYS}"
_PATHS = f"conv_id long, depth long, fa long, fb long, ga long, gb long, before long, last boolean, {_KEYS}, turn_conv long, turn_place long"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _columns(batch: pd.DataFrame, names: list[str]) -> Iterator[tuple]:
    return zip(*(batch[x].tolist() for x in names))


def stored_turns(convs: DataFrame, seed: int) -> DataFrame:
    """conv_id, turn, words of the text, and a 128-bit key of role and text."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), common.text_of("text")
    return convs.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.xxhash64(F.lit(seed), role, text).alias("key_a"), F.xxhash64(role, text, F.lit(seed)).alias("key_b"),
        F.regexp_count(text, F.lit(common.WORD_RE)).cast("long").alias("words"),
        role.alias("role"), text.alias("text"),
    )


def unequal_turns(turns: DataFrame) -> DataFrame:
    """Content keys that stand for different turns (none, but for hash collisions)."""
    bounds = [f(c).alias(f"{c}_{n}") for c in ("role", "text") for n, f in (("lo", F.min), ("hi", F.max))]
    return turns.groupBy("key_a", "key_b").agg(*bounds).where("role_lo <> role_hi OR text_lo <> text_hi").select("key_a", "key_b")


def prefix_products(turns: DataFrame, base: int) -> DataFrame:
    """Per stored turn: its place (from 1), the product of the conversation's turns up to it (fa, fb) and before it (ga, gb), words up to it."""
    spark = turns.sparkSession
    order = ["conv_id", "turn", "key_a", "key_b"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = turns.select(*order, "words").repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        conv, n, f, upto = None, 0, 0, 0
        for batch in batches:
            out = []
            for c, a, b, w in _columns(batch, ["conv_id", "key_a", "key_b", "words"]):
                if c != conv:
                    conv, n, f, upto = c, 0, 0, 0
                n, f, upto = n + 1, product(f, turn_element(a, b), 1, base), upto + w
                out.append((part, c, n, *_split(f), upto, a, b, w))
            yield pd.DataFrame(out, columns=_names(_SCAN))

    scanned = common.materialise(ranged.select("conv_id", "key_a", "key_b", "words").mapInPandas(scan, _SCAN), "trie-scan")
    # What one conversation has in each range: a row per task, so the driver sees as many rows as there are ranges.
    ends = scanned.groupBy("part").agg(
        F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "n", "pa", "pb", "upto")).alias("last")
    )
    carry, run = [], None
    for row in sorted(ends.collect(), key=lambda r: r["part"]):
        last = row["last"]
        if run and run[0] == row["first"]:
            carry.append((row["part"], run[0], run[1], *_split(run[2]), run[3]))
        joined = run and run[0] == row["first"] == last["conv_id"]
        n, f, w = run[1:] if joined else (0, 0, 0)
        run = (last["conv_id"], n + last["n"], product(f, _join(last["pa"], last["pb"]), last["n"], base), w + last["upto"])
    carried = spark.createDataFrame(carry, "part int, conv_id long, n0 long, a0 long, b0 long, w0 long")
    met = scanned.join(F.broadcast(carried), ["part", "conv_id"], "left")
    inverse = pow(base, -1, PRIME)

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for c, n, pa, pb, upto, a, b, w, n0, a0, b0, w0 in _columns(
                    batch, ["conv_id", "n", "pa", "pb", "upto", "key_a", "key_b", "words", "n0", "a0", "b0", "w0"]):
                f = _join(pa, pb)
                if n0:
                    f = product(_join(a0, b0), f, n, base)
                out.append((c, n0 + n, *_split(f), *_split((f - turn_element(a, b)) * inverse % PRIME), w0 + upto, a, b, w))
            yield pd.DataFrame(out, columns=_names(_PREFIX))

    filled = met.select(*scanned.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n0", "a0", "b0", "w0")])
    out = common.materialise(filled.mapInPandas(compose, _PREFIX), "trie-prefixes")
    common.drop_written(scanned)
    return out


# ---- rebuilt conversations -----------------------------------------------------


def head_turns(conv_id: Column) -> Column:
    """h of the contract."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("int")


def rebuilt(prefixes: DataFrame) -> DataFrame:
    """One row per conversation: head (the base's first turns with their products), the product, words and number of own turns that it replaces, depth, tokens."""
    base_of = F.col("conv_id") - F.col("conv_id") % GROUP
    at_h = lambda c: F.coalesce(F.max(F.when(F.col("place") == F.col("h"), F.col(c))), F.lit(0))
    own = (
        prefixes.withColumn("h", head_turns(F.col("conv_id"))).groupBy("conv_id", "h")
        .agg(F.count("*").alias("n_own"), F.max("upto").alias("own_words"), *[at_h(c).alias(f"own_{c}") for c in ("fa", "fb", "upto")])
    )
    entry = F.struct("place", "fa", "fb", "ga", "gb", "upto", "key_a", "key_b", "words")
    heads = (
        prefixes.where((F.col("conv_id") % GROUP == 0) & (F.col("place") < HEADS))
        .groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(entry)).alias("turns"))
    )
    joined = own.withColumn("base", base_of).join(heads, "base", "left").withColumn("head", F.slice(F.coalesce("turns", F.array()), 1, F.col("h")))
    end = F.expr("head[size(head) - 1]")
    has = F.size("head") > 0
    out = joined.withColumns({
        "n_head": F.size("head").cast("long"),
        "n_rest": F.greatest(F.col("n_own") - F.col("h"), F.lit(0)).cast("long"),
        "head_fa": F.when(has, end["fa"]).otherwise(0), "head_fb": F.when(has, end["fb"]).otherwise(0),
        "head_words": F.when(has, end["upto"]).otherwise(0),
    })
    rest_words = F.when(F.col("n_rest") > 0, F.col("own_words") - F.col("own_upto")).otherwise(0)
    return common.materialise(
        out.select(
            "conv_id", "base", "h", "n_head", "head", "head_fa", "head_fb", "head_words", "own_fa", "own_fb", "own_upto", "n_rest",
            (F.col("n_head") + F.col("n_rest")).alias("depth"), (F.col("head_words") + rest_words).alias("tokens"),
        ),
        "trie-conversations",
    )


def paths(prefixes: DataFrame, convs: DataFrame, base: int) -> DataFrame:
    """One row per rebuilt conversation and depth from 1: fingerprints of the prefix and of its parent, and the reference of its last turn."""
    head = convs.select("conv_id", "n_head", "n_rest", "base", F.explode("head").alias("t")).select(
        "conv_id", F.col("t.place").alias("depth"), *[F.col(f"t.{c}").alias(c) for c in ("fa", "fb", "ga", "gb")],
        (F.col("t.upto") - F.col("t.words")).alias("before"), ((F.col("t.place") == F.col("n_head")) & (F.col("n_rest") == 0)).alias("last"),
        "t.key_a", "t.key_b", "t.words", F.col("base").alias("turn_conv"), F.col("t.place").alias("turn_place"),
    )
    own = prefixes.where(F.col("place") > head_turns(F.col("conv_id"))).drop("ga", "gb").join(convs.drop("head", "depth", "tokens"), "conv_id")
    inverse = pow(base, -1, PRIME)
    wanted = ["conv_id", "place", "fa", "fb", "upto", "key_a", "key_b", "words", "h", "n_head", "n_rest",
              "head_fa", "head_fb", "head_words", "own_fa", "own_fb", "own_upto"]

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for c, k, fa, fb, upto, a, b, w, h, n_head, n_rest, ha, hb, hw, oa, ob, ow in _columns(batch, wanted):
                # The own turns h+1..k are what multiplies the product of the first h to that of the first k.
                stretch = (_join(fa, fb) - product(_join(oa, ob), 0, k - h, base)) % PRIME
                f = product(_join(ha, hb), stretch, k - h, base)
                g = (f - turn_element(a, b)) * inverse % PRIME
                out.append((c, n_head + k - h, *_split(f), *_split(g), hw + upto - w - ow, k - h == n_rest, a, b, w, c, k))
            yield pd.DataFrame(out, columns=_names(_PATHS))

    return common.materialise(head.unionByName(own.select(*wanted).mapInPandas(compose, _PATHS)), "trie-paths")


def _chunk_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chunks of the id lists; the rows come sorted by node and id."""
    names = ["depth", "fa", "fb", "first", "ids"]
    node, ids = None, []
    for batch in batches:
        out = []
        for d, a, b, c in _columns(batch, ["depth", "fa", "fb", "conv_id"]):
            if (d, a, b) != node or len(ids) == CHUNK_IDS:
                if ids:
                    out.append((*node, ids[0], ",".join(map(str, ids))))
                node, ids = (d, a, b), []
            ids.append(c)
        yield pd.DataFrame(out, columns=names)
    if ids:
        yield pd.DataFrame([(*node, ids[0], ",".join(map(str, ids)))], columns=names)


def _hash_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["depth", "fa", "fb", "ends_sha256"]
    node, digest = None, None
    for batch in batches:
        out = []
        for d, a, b, ids in _columns(batch, ["depth", "fa", "fb", "ids"]):
            if (d, a, b) == node:
                digest.update(b",")
            else:
                if node:
                    out.append((*node, digest.hexdigest()))
                node, digest = (d, a, b), hashlib.sha256()
            digest.update(ids.encode())
        yield pd.DataFrame(out, columns=names)
    if node:
        yield pd.DataFrame([(*node, digest.hexdigest())], columns=names)


def id_list_hashes(ends: DataFrame) -> DataFrame:
    """depth, fa, fb and the SHA-256 of the sorted, comma-joined ids of the rows (depth, fa, fb, conv_id).

    SHA-256 can't be put together from parts, so one task must see a node's
    whole list; it sees chunks of joined ids (made by tasks over sorted
    ranges, however many ids a node has) and holds one at a time.
    """
    order = ["depth", "fa", "fb", "conv_id"]
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = ends.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    chunks = common.materialise(ranged.mapInPandas(_chunk_rows, "depth long, fa long, fb long, first long, ids string"), "trie-ends")
    dealt = chunks.repartition(*order[:3]).sortWithinPartitions(*order[:3], "first")
    return dealt.mapInPandas(_hash_rows, "depth long, fa long, fb long, ends_sha256 string")


def _sums(steps: DataFrame, convs: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves and saved tokens of every node but the root, and of the root.

    A conversation c is the smallest member of its nodes from some depth r on
    (if at all): the nodes' own rows say which. The sum over a subtree of
    (members - 1) * words is that over all (member, depth) pairs minus that
    over the nodes, each counted at its smallest member. With T the words of
    c and s(d) those before depth d, member c adds T - s(d) and takes
    T - s(max(d, r)). A leaf is counted at its smallest member too.
    """
    reps = nodes.groupBy("conv_id").agg(
        F.min("before").alias("from_words"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf")
    )
    known = common.materialise(convs.select("conv_id", "tokens").join(reps, "conv_id", "left"), "trie-members")
    def saved(before: Column) -> Column:
        return F.when(F.col("from_words").isNull(), F.col("tokens") - before).otherwise(F.greatest(F.lit(0), F.col("from_words") - before))

    leaf = F.coalesce("leaf", F.lit(0))
    inner = (
        steps.select("conv_id", "depth", "fa", "fb", "before").join(known, "conv_id")
        .groupBy("depth", "fa", "fb").agg(F.sum(leaf).alias("n_leaves"), F.sum(saved(F.col("before"))).alias("saved_tokens"))
    )
    root = known.agg(F.sum(leaf).alias("n_leaves"), F.sum(saved(F.lit(0))).alias("saved_tokens"))
    zero = F.lit(0).cast("long")
    return inner, root.where("n_leaves IS NOT NULL").select(zero.alias("depth"), zero.alias("fa"), zero.alias("fb"), "n_leaves", "saved_tokens")


def prefix_trie(convs: DataFrame) -> DataFrame:
    """All nodes of the trie of rebuilt conversations.

    Returns conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256 and the reference of the
    node's last turn (turn_conv, turn_place from 1; null at the root).
    """
    for seed, base in enumerate(BASES):
        out = _trie(convs, seed, base)
        if out is not None:
            return out
    raise RuntimeError("fingerprints collide with every base")


def _trie(convs: DataFrame, seed: int, base: int) -> DataFrame | None:
    turns = stored_turns(convs, seed)
    if not unequal_turns(turns).isEmpty():
        return None
    prefixes = prefix_products(turns, base)
    members = rebuilt(prefixes)
    steps = paths(prefixes, members, base)
    common.drop_written(prefixes)
    same = ["ga", "gb", "key_a", "key_b", "before"]
    grouped = common.materialise(
        steps.groupBy("depth", "fa", "fb").agg(
            F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"),
            F.min_by("turn_conv", "conv_id").alias("turn_conv"), F.min_by("turn_place", "conv_id").alias("turn_place"),
            *[F.min(c).alias(c) for c in same], *[F.max(c).alias(f"max_{c}") for c in same],
        ),
        "trie-groups",
    )
    if not grouped.where(" OR ".join(f"{c} <> max_{c}" for c in same)).isEmpty():
        return None
    zero, nothing = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = members.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0").select(
        *[zero.alias(c) for c in ("depth", "fa", "fb")], "n_convs", "conv_id", nothing.alias("turn_conv"), nothing.alias("turn_place"),
        nothing.alias("ga"), nothing.alias("gb"), zero.alias("before"),
    )
    children = grouped.groupBy((F.col("depth") - 1).alias("depth"), F.col("ga").alias("fa"), F.col("gb").alias("fb")).agg(F.count("*").alias("n_children"))
    node = ["depth", "fa", "fb"]
    nodes = common.materialise(
        grouped.select(*root.columns).unionByName(root).join(children, node, "left").withColumn("n_children", F.coalesce("n_children", zero)),
        "trie-nodes",
    )
    inner, top = _sums(steps, members, nodes)
    ends = steps.where("last").select(*node, "conv_id").unionByName(
        members.where("depth = 0").select(*[zero.alias(c) for c in node], "conv_id")
    )
    sums = common.materialise(inner.unionByName(top), "trie-sums")
    hashes = common.materialise(id_list_hashes(ends), "trie-hashes")
    common.drop_written(steps, members, grouped)
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("fa").alias("ga"), F.col("fb").alias("gb"), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.join(sums, node).join(hashes, node, "left").join(parents, ["depth", "ga", "gb"], "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), "turn_conv", "turn_place",
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of all rebuilt conversations."""
    return prefix_trie(common.read_table(spark, sf_dir, "conversations")).drop("turn_conv", "turn_place")


OP11_SQL = r"""
WITH tab AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
               lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crcs),
ids AS (SELECT conv_id AS c, (xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
               lambda a, x: xor(a >> 8, crcs[(xor(a, x) & 255) + 1])), 4294967295) % 4)::BIGINT AS h
        FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), tab),
t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS txt,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k
      FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT ids.c, 0 AS own, t.k, t.role, t.txt FROM ids JOIN t ON t.c = ids.c - ids.c % 20 AND t.k <= ids.h
      UNION ALL SELECT ids.c, 1, t.k, t.role, t.txt FROM ids JOIN t ON t.c = ids.c AND t.k > ids.h),
s AS (SELECT c, row_number() OVER w AS d, {'role': role, 'txt': txt} AS last,
             list({'role': role, 'txt': txt}) OVER (PARTITION BY c ORDER BY own, k ROWS UNBOUNDED PRECEDING) AS p
      FROM r WINDOW w AS (PARTITION BY c ORDER BY own, k)),
p AS (SELECT c, d, p FROM s UNION ALL SELECT c, 0, [] FROM ids),
full_len AS (SELECT c, max(d) AS n FROM p GROUP BY c),
nodes AS (SELECT p, d, min(c) AS c, count(*) AS n,
                 string_agg(p.c::VARCHAR, ',' ORDER BY p.c) FILTER (WHERE f.n = p.d) AS ends
          FROM p JOIN full_len f USING (c) GROUP BY p, d),
sized AS (SELECT *, CASE WHEN d = 0 THEN 0 ELSE (n - 1) * len(regexp_extract_all(p[d].txt, '[^\x20\x09-\x0D]+')) END AS saved FROM nodes),
kids AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS m FROM nodes WHERE d > 0 GROUP BY ALL),
marked AS (SELECT s.*, coalesce(m, 0) AS m FROM sized s LEFT JOIN kids USING (p, d)),
sub AS (SELECT p[1:a] AS p, a AS d, sum(saved) AS saved, count(*) FILTER (WHERE m = 0) AS leaves
        FROM (SELECT p, saved, m, unnest(range(0, d + 1)) AS a FROM marked) GROUP BY ALL)
SELECT x.c AS conv_id, x.d::BIGINT AS depth, up.c AS parent_conv_id, x.n AS n_convs, x.m::BIGINT AS n_children, sub.leaves AS n_leaves,
       sub.saved::BIGINT AS saved_tokens, sha256(coalesce(x.ends, '')) AS ends_sha256
FROM marked x JOIN sub USING (p, d) LEFT JOIN nodes up ON up.d = x.d - 1 AND up.p = x.p[1:x.d - 1]
"""
