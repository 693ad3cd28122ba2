"""SimHash near-duplicates with pigeonring filtering.

A fingerprint bit is set if it is set in over half of the hashes of a text's
word shingles. Two fingerprints link at ``max_bits`` or fewer differing bits.

The 64 bits are sixteen segments of four around a ring. If at most three bits
differ, then from some segment on every chain of l consecutive segments holds
at most l * 3 / 16 of the differences (pigeonring principle): none in the first
five segments, at most one in ten, two in fifteen. The one difference that the
sixth to tenth segment may hold lies in one third of their 20 bits, so the other
two thirds agree. Fingerprints meet, from each of the sixteen starts, by the
first five segments and two of the three thirds behind them: 33 or 34 bits, so
strangers hardly ever meet, even among billions of fingerprints. The chain sums
prune a pair before the full Hamming check. A meeting place with too many
fingerprints is cut into chunks, and each pair of chunks is a task of its own.
A task returns no pairs but one link per fingerprint to the first of its local
component, so dense groups stay linear.

Defined cases: a null or wordless text has fingerprint zero and links like any
other; a text shorter than a shingle is one shingle; repeated rows share a
fingerprint; a null id never becomes a component's id unless the component
has no other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import components

SHINGLE = 3
MAX_BITS = 3
SEED = 42
SEGMENTS, SEGMENT_BITS = 16, 4
CHAIN_BITS = 40      # ten segments: none of the differences in the first five, at most one in the others
THIRDS = (0b1111111 << 13, 0b1111111 << 6, 0b111111)  # of the last five segments' bits
CHUNK = 2048         # fingerprints of one meeting place that are compared in one go


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """SimHash of a whole text (unsigned)."""
    import xxhash

    # bytes.lower and bytes.split know ASCII only: A-Z, and blank and 0x09-0x0D.
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        joined = [b" ".join(words)]
    else:
        joined = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in joined], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (counts * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, uid (hash of the text) and fp (the fingerprint as a signed 64-bit number)."""
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), common.text_of(text_col).alias("text"))
    keep = rows.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("uid", T.LongType()), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"id": batch["id"], "uid": batch["uid"], "fp": fps})

    # Ids travel as strings, so null ids keep their type.
    out = rows.select(F.col("doc_id").cast("string").alias("id"), F.xxhash64("text").alias("uid"), "text").mapInPandas(run, schema)
    return out.select(F.col("id").cast(keep).alias("doc_id"), "uid", "fp")


def _close(x: np.ndarray, max_bits: int) -> np.ndarray:
    """Chain budgets of the differences ``x`` of rotated fingerprints, then the full distance."""
    ok = np.ones(len(x), dtype=bool)
    for segments in range(1, SEGMENTS):
        budget = segments * max_bits // SEGMENTS
        if (segments + 1) * max_bits // SEGMENTS > budget:  # the longest chain with this budget
            ok &= np.bitwise_count(x >> np.uint64(64 - SEGMENT_BITS * segments)) <= budget
    ok[ok] = np.bitwise_count(x[ok]) <= max_bits
    return ok


def _local_links(values: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """(first, member) links that connect each local component of one meeting place.

    Breadth first: a found fingerprint is compared with those not yet reached
    only, so a dense group costs little more than one pass.
    """
    links = []
    rest = np.arange(len(values))
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        front = [root]
        while front and len(rest):
            near = _close(values[rest] ^ values[front.pop()], max_bits)
            if near.any():
                found = rest[near]
                rest = rest[~near]
                links += [(root, int(i)) for i in found]
                front += found.tolist()
    return links


def _small_links(values: np.ndarray, group: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked index pairs of neighbours at every distance within the same group (groups are short runs)."""
    left, right = [], []
    lag = 1
    while lag < len(values):
        i = np.flatnonzero(group[lag:] == group[:-lag])
        if not len(i):
            break
        ok = i[_close(values[i] ^ values[i + lag], max_bits)]
        left.append(ok)
        right.append(ok + lag)
        lag += 1
    return np.concatenate(left or [np.zeros(0, int)]), np.concatenate(right or [np.zeros(0, int)])


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges (u, v) that connect all fingerprints within ``max_bits``; ``fps`` has one distinct column fp."""
    if not 0 <= max_bits < SEGMENTS // 5 + 1:
        raise ValueError("five segments without a difference need max_bits of at most 3")
    turned = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1))).alias("t")).select(
        "t", F.expr(f"shiftleft(fp, {SEGMENT_BITS} * t) | IF(t = 0, 0L, shiftrightunsigned(fp, 64 - {SEGMENT_BITS} * t))").alias("rot")
    )
    # The number of the start and of the third left out, then the chain without that third.
    chain = f"shiftrightunsigned(rot, {64 - CHAIN_BITS})"
    keys = [f"shiftleft(t * {len(THIRDS)}L + {i}, {CHAIN_BITS}) | ({chain} & ~{third}L)" for i, third in enumerate(THIRDS)]
    places = turned.select(F.explode(F.expr(f"array({', '.join(keys)})")).alias("key"), "rot")
    hot = common.materialise(
        places.groupBy("key").count().where(F.col("count") > CHUNK)
        .select("key", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks")),
        "simhash-hot",
    )
    own = F.expr("pmod(xxhash64(rot), chunks)").cast("int")
    dealt = (
        places.join(hot, "key", "left")
        .withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        .withColumn("own", own)
        .select("key", "rot", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
        .select("key", "rot", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
        .repartition("key", "lo", "hi")
        .sortWithinPartitions("key", "lo", "hi")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []

        def finish(rows: np.ndarray) -> pd.DataFrame:
            key, values = rows["key"], rows["rot"].view(np.uint64)
            change = np.flatnonzero((key[1:] != key[:-1]) | (rows["lo"][1:] != rows["lo"][:-1]) | (rows["hi"][1:] != rows["hi"][:-1])) + 1
            starts = np.concatenate([[0], change])
            sizes = np.diff(np.concatenate([starts, [len(rows)]]))
            group = np.repeat(np.arange(len(starts)), sizes)
            small = np.flatnonzero((sizes <= 64)[group])
            a, b = _small_links(values[small], group[small], max_bits)
            u, v = [small[a]], [small[b]]
            for g in np.flatnonzero(sizes > 64):
                pairs = np.array(_local_links(values[starts[g]:starts[g] + sizes[g]], max_bits), dtype=int).reshape(-1, 2)
                u.append(pairs[:, 0] + starts[g])
                v.append(pairs[:, 1] + starts[g])
            u, v = np.concatenate(u), np.concatenate(v)
            turn = ((key >> CHAIN_BITS) // len(THIRDS)).astype(np.uint64) * np.uint64(SEGMENT_BITS)
            back = np.where(turn == 0, values, (values >> turn) | (values << ((np.uint64(64) - turn) % np.uint64(64))))
            back = back.view(np.int64)
            return pd.DataFrame({"u": back[u], "v": back[v]})

        for batch in batches:
            if not len(batch):
                continue
            held.append(batch.to_records(index=False).astype([("key", "i8"), ("rot", "i8"), ("lo", "i4"), ("hi", "i4")]))
            rows = np.concatenate(held)
            same = (rows["key"] == rows["key"][-1]) & (rows["lo"] == rows["lo"][-1]) & (rows["hi"] == rows["hi"][-1])
            cut = int(same.argmax())
            held = [rows[cut:]]
            if cut:
                yield finish(rows[:cut])
        if held and len(held[0]):
            yield finish(held[0])

    return dealt.mapInPandas(run, "u long, v long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS
) -> DataFrame:
    """One row per document: doc_id, uid (hash of the text), fp, component_id (least doc_id
    of all documents it is linked with) and root (a fingerprint that names the component)."""
    each = common.materialise(fingerprints(docs, id_col, text_col, shingle), "simhash-fps")
    distinct = common.materialise(each.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(distinct.select("fp"), max_bits))
    rooted = distinct.join(roots.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = common.materialise(rooted.join(ids, "root").select("fp", "component_id", "root"), "simhash-components")
    return each.join(by_fp, "fp").select("doc_id", "uid", "fp", "component_id", "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """The rows of ``docs`` of which one stays for each component: the least id, then the least text hash.

    Rows that repeat both id and text count as one. Only rows that go, and
    rows repeated as a whole, are shuffled (rows that may be among them, that is).
    """
    found = common.materialise(near_duplicates(docs, id_col, text_col, **limits), "simhash-found")
    least = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid")
    kept = common.materialise(found.groupBy("root").agg(F.min(least).alias("k"), F.count("*").alias("rows")).where("rows > 1"), "simhash-kept")
    # One row per (id, text) that goes or comes more than once; most documents are neither.
    decided = (
        found.join(kept, "root").groupBy("uid", "doc_id")
        .agg(F.first(F.col("k.uid") == F.col("uid")).alias("same"), F.first(F.col("k.doc_id").eqNullSafe(F.col("doc_id"))).alias("own"), F.count("*").alias("n"))
        .select("uid", F.xxhash64("doc_id", F.col("doc_id").isNull()).alias("id_hash"), "doc_id", (F.col("same") & F.col("own")).alias("stays"), "n")
        .where("NOT stays OR n > 1")
    )
    decided = common.materialise(decided.select(F.xxhash64("uid", "id_hash").alias("key"), "uid", F.col("doc_id").alias("met_id"), "stays"), "simhash-decided")
    uid = F.xxhash64(common.text_of(text_col))
    id_hash = F.xxhash64(F.col(id_col), F.col(id_col).isNull())
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("row_id"), uid.alias("row_uid"), F.xxhash64(uid, id_hash).alias("key"))
    tested = common.may_hold(rows, decided, "key")
    plain = tested.where("NOT may_hold").select("row.*")
    same = [F.col("r.key") == F.col("d.key"), F.col("r.row_uid") == F.col("d.uid"), F.col("r.row_id").eqNullSafe(F.col("d.met_id"))]
    met = tested.where("may_hold").alias("r").join(decided.alias("d"), same, "left").select("r.row", "r.row_uid", "r.row_id", "d.stays")
    alone = met.where("stays IS NULL").select("row.*")
    repeated = met.where("stays").groupBy("row_uid", "row_id").agg(F.first("row").alias("row")).select("row.*")
    return plain.unionByName(alone).unionByName(repeated)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near-duplicate classes of all documents."""
    found = near_duplicates(common.read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
