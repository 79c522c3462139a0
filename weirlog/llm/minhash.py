"""MinHash near-duplicates by ProbMinHash over weighted word shingles, with banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shipping import ship
from .common import components, stage
from .shingles import M64, mix, shingles_of

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 21, 6
SLOTS = BANDS * ROWS
#: Pairs whose estimate is under the similarity by this much, four standard deviations at 0.8, are not verified.
SLACK = 0.14
#: Documents of one block; a larger group is compared block by block.
BLOCK = 512
#: Groups of more blocks are joined in rounds first, as comparing all their blocks grows with the square of their number.
DIRECT = 8
#: Documents of each component that meet others' in a round, and rounds at most.
AMBASSADORS, ROUNDS = 4, 8
#: Bytes of text, and documents, signed at a time.
CHUNK, CHUNK_DOCS = 1 << 21, 2_000


def signatures(h: np.ndarray, owner: np.ndarray, weight: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """ProbMinHash signatures (n, slots) of n weighted sets given as (hash, owner, weight).

    Every element is a Poisson process with its weight as rate; each arrival falls into one slot. A slot keeps the
    element that arrived first. An element stops as soon as its next arrival is later than every slot's first of its
    set. Two signatures agree in a slot with the sets' probability Jaccard similarity as probability.
    """
    first = np.full(n * slots, np.inf)
    who = np.zeros(n * slots, M64)
    live = np.arange(len(h))
    time = np.zeros(len(h))
    r = 0
    while len(live):
        x = mix(h[live] + M64((0x9E3779B97F4A7C15 * (r + 1)) & (2**64 - 1)))
        time[live] -= np.log(((x >> M64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[live]
        slot = owner[live] * slots + (mix(x ^ M64(0xD1B54A32D192ED03)) % M64(slots)).astype(np.int64)
        t = time[live]
        np.minimum.at(first, slot, t)
        won = first[slot] == t
        who[slot[won]] = h[live][won]
        last = first.reshape(n, slots).max(axis=1)
        live = live[t < last[owner[live]]]
        r += 1
    return (mix(who) >> M64(32)).astype(np.uint32).reshape(n, slots)


def weights_of(times: np.ndarray) -> np.ndarray:
    """A shingle's weight grows with the logarithm of its count, so repeated lines do not drown the rest."""
    return 1.0 + np.log(times)


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Sum over common elements i of 1 / sum_j max(x_j / x_i, y_j / y_i); a and b are sorted, x and y their weights."""
    if not len(a) or not len(b):
        return 0.0
    common, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    if x.max() == y.max() == 1.0:
        return len(common) / (len(a) + len(b) - len(common))
    u, v = x[i], y[j]
    order = np.argsort(-(u / v), kind="stable")
    u, v = u[order], v[order]
    only_x, only_y = x.sum() - u.sum(), y.sum() - v.sum()
    up, down = only_x + np.cumsum(u), only_y + v.sum() - np.cumsum(v)
    return float((1.0 / (up / u + down / v)).sum())


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "tag", "k1", "k2", "sig", "bands"]

    def out(ids: list, tags: list, texts: list[bytes]) -> pa.RecordBatch:
        h, owner, times, one, two = shingles_of(texts, WORDS)
        sig = signatures(h, owner, weights_of(times), len(texts))
        full = np.bincount(owner, minlength=len(texts)) > 0
        band = np.zeros((len(texts), BANDS), M64)
        parts = sig.reshape(len(texts), BANDS, ROWS).astype(M64)
        for r in range(ROWS):
            band = mix(band * M64(0x9E3779B97F4A7C15) + parts[:, :, r] + M64(r + 1))
        band = mix(band + np.arange(1, BANDS + 1, dtype=M64)).view(np.int64)
        cols = [
            pa.array(ids, pa.int64()), pa.array(tags, pa.int64()), pa.array(one.view(np.int64), mask=~full), pa.array(two.view(np.int64), mask=~full),
            pa.array([s.tobytes() if f else None for s, f in zip(sig, full, strict=True)], pa.binary()),
            pa.array([list(b) if f else None for b, f in zip(band.tolist(), full, strict=True)], pa.list_(pa.int64())),
        ]
        return pa.record_batch(cols, names=names)

    ids, tags = [], []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        for i, g, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ids.append(i)
            tags.append(g)
            texts.append((t or "").encode())
            size += len(texts[-1])
            if size >= CHUNK or len(ids) >= CHUNK_DOCS:
                yield out(ids, tags, texts)
                ids, tags, texts, size = [], [], [], 0
    if ids:
        yield out(ids, tags, texts)


class _Forest:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i


def _verify_unit(rows: list[tuple], threshold: float) -> list[tuple[int, int, float]]:
    """Links that join the unit's documents: pairs by falling estimate, each verified unless already joined.

    rows are (rep, block, comp, sig, text); rows of one comp or rep count as joined. Two blocks are compared with each
    other, one with itself.
    """
    rows = sorted(set(rows), key=lambda r: (r[0], r[1], r[4]))
    forest = _Forest(len(rows))
    seen: dict[int, int] = {}
    for k, r in enumerate(rows):
        forest.up[k] = seen.setdefault(r[2], k)
    sig = np.stack([np.frombuffer(r[3], dtype=np.uint32) for r in rows])
    block = np.array([r[1] for r in rows])
    left = np.flatnonzero(block == block.min())
    right = np.flatnonzero(block == block.max())
    same = np.zeros((len(left), len(right)), dtype=np.int16)
    for k in range(sig.shape[1]):
        same += sig[left, k][:, None] == sig[right, k][None, :]
    i, j = np.nonzero(same >= (threshold - SLACK) * sig.shape[1])
    guess = same[i, j]
    i, j = left[i], right[j]
    ok = i < j if block.min() == block.max() else np.ones(len(i), dtype=bool)
    i, j, guess = i[ok], j[ok], guess[ok]
    order = np.argsort(-guess, kind="stable")
    found = []
    sets: dict[int, tuple] = {}

    def shingled(q: int) -> tuple:
        if q not in sets:
            h, _, times, _, _ = shingles_of([rows[q][4].encode()], WORDS)
            sets[q] = (h, weights_of(times))
        return sets[q]

    for p, q in zip(i[order].tolist(), j[order].tolist(), strict=True):
        a, b = forest.root(p), forest.root(q)
        if a != b:
            s = probability_jaccard(*shingled(p), *shingled(q))
            if s >= threshold:
                forest.up[a] = b
                found.append((rows[p][0], rows[q][0], s))
    return found


def _verify(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by unit; one unit is held at a time."""
    unit, rows = None, []

    def out() -> pa.RecordBatch:
        found = _verify_unit(rows, threshold) if len(rows) > 1 else []
        return pa.record_batch([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "similarity"])

    for batch in batches:
        for root, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if unit != (root, i, j):
                if len(rows) > 1:
                    yield out()
                unit, rows = (root, i, j), []
            rows.append(tuple(row))
    if len(rows) > 1:
        yield out()


def _links_of(units: DataFrame, threshold: float) -> DataFrame:
    """Verified links of units (root, i, j) of rows (rep, block, comp, sig, text)."""
    u = units.select("root", "i", "j", "rep", "block", "comp", "sig", "text").repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    return stage(u.mapInArrow(lambda it: _verify(it, threshold), "a long, b long, similarity double"), "mhlink")


def _with_component(rows: DataFrame, links: DataFrame) -> DataFrame:
    joined = components(links, "a", "b").select(F.col("node").alias("n"), F.col("root").alias("c"))
    return stage(rows.join(joined, F.col("rep") == F.col("n"), "left").select("rep", "root", F.coalesce("c", "rep").alias("comp")), "mhcomp")


def _join_groups(full: DataFrame, threshold: float) -> DataFrame:
    """Links that join each group's linked documents; full is (root, rep, sig, text), staged.

    A group of up to DIRECT blocks is compared whole, block by block. A larger one is compared within blocks first; then, round by round, a few
    ambassadors of each component so far meet in new blocks, while that joins more; at last all documents of different
    components that remain are compared, block by block. A component never meets itself again, so a large group of
    near copies, which the first rounds join, is not compared pair by pair.
    """
    size = stage(full.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks")), "mhsize")
    sized = full.join(size, "root").withColumns({"block": F.pmod(F.xxhash64("rep"), F.col("blocks")), "comp": F.col("rep")})
    others = F.when(F.col("blocks") <= DIRECT, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.col("block")))
    met = sized.withColumn("other", F.explode(others))
    links = _links_of(met.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}), threshold)
    large = size.where(F.col("blocks") > DIRECT).select("root")
    if not large.limit(1).count():
        return links
    ids = stage(full.select("rep", "root").distinct().join(large, "root", "left_semi"), "mhlarge")
    left = None
    for turn in range(ROUNDS):
        of = _with_component(ids, links)
        many = of.groupBy("root").agg(F.count_distinct("comp").alias("k")).where("k > 1")
        total = many.agg(F.sum("k")).first()[0]
        if not total:
            return links
        if left is not None and total > 0.9 * left:
            break
        left = total
        picks = [F.min_by("rep", F.xxhash64(F.lit(turn * AMBASSADORS + k), "rep")) for k in range(AMBASSADORS)]
        envoys = of.join(many.select("root"), "root", "left_semi").groupBy("root", "comp").agg(F.array_distinct(F.array(*picks)).alias("reps"))
        envoys = stage(envoys.select("root", "comp", F.explode("reps").alias("rep")), "mhenvoy")
        blocks = envoys.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
        placed = envoys.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64(F.lit(turn), "comp"), F.col("blocks")))
        rows = placed.join(full.drop("root"), "rep").withColumns({"i": F.col("block"), "j": F.col("block")})
        links = links.unionByName(_links_of(rows, threshold))
    return links.unionByName(_links_of(_different(of.join(many.select("root"), "root", "left_semi"), full), threshold))


def _different(of: DataFrame, full: DataFrame) -> DataFrame:
    """Units of all pairs of blocks that hold different components; of is (rep, root, comp).

    A component of half a block or more has blocks of its own, smaller ones share blocks.
    """
    n = of.groupBy("root", "comp").agg(F.count("*").alias("n"))
    small = n.where(F.col("n") < BLOCK / 2).groupBy(F.col("root").alias("r")).agg(F.ceil(F.sum("n") / BLOCK).cast("long").alias("pools"))
    n = stage(n.join(small, F.col("root") == F.col("r"), "left").drop("r"), "mhparts")
    n = n.select(F.col("root").alias("r"), F.col("comp").alias("c"), "n", "pools")
    rows = of.join(n, (F.col("root") == F.col("r")) & (F.col("comp") == F.col("c"))).drop("r", "c")
    own = F.when(F.col("n") >= BLOCK / 2, F.col("comp"))
    part = F.when(own.isNotNull(), F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / BLOCK))).otherwise(F.pmod(F.xxhash64("comp"), F.col("pools")))
    rows = stage(rows.select("rep", "root", "comp", own.alias("own"), F.concat_ws(":", F.coalesce(own.cast("string"), F.lit("pool")), part.cast("string")).alias("bid")), "mhblocks")
    b = rows.select("root", "own", "bid").distinct()
    x, y = b.select("root", F.col("bid").alias("i"), F.col("own").alias("oi")), b.select(F.col("root").alias("r"), F.col("bid").alias("j"), F.col("own").alias("oj"))
    pairs = x.join(y, (F.col("root") == F.col("r")) & (F.col("i") <= F.col("j")) & (F.col("oi").isNull() | F.col("oj").isNull() | (F.col("oi") != F.col("oj"))))
    pairs = stage(pairs.select(F.col("r"), "i", "j"), "mhpairs")
    side = lambda end, number: rows.join(pairs, (F.col("root") == F.col("r")) & (F.col("bid") == F.col(end))).withColumn("block", F.lit(number).cast("long"))
    units = side("i", 0).unionByName(side("j", 1).where("i <> j"))
    return units.join(full.drop("root"), "rep")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """Classes of near-duplicate documents: probability Jaccard of weighted five-word shingles of at least `threshold`.

    1. Each partition signs its texts. 2. Rows with equal word sequences become one class, named by its smallest id, by
    a hash aggregate. 3. Band buckets tie representatives to the bucket's smallest; connected ties make groups.
    4. Within a group, pairs are estimated from signatures; by falling estimate, those not yet joined are verified on
    the exact shingles. Units of work hold two blocks at most, so no task holds a group, and no pairs are emitted but the
    verified links that join classes (see _join_groups). 5. Linked classes are connected.

    Null, empty and blank texts have no shingles and join nothing; a text under five words has one shingle. A null id
    is in no class but its own (class_id null, kept). Rows that repeat an id are one document, alike to what any of its texts is; each gets its row.
    Empty table: no rows. Other columns are not read. Returns (doc_id, class_id, copy_id, kept): class_id is the
    smallest id reachable, copy_id the smallest with the same words, kept whether the row's id is its class.
    """
    ship(docs.sparkSession)
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("tag"), F.col(text_col).alias("text"))
    signed = stage(text.mapInArrow(_sign, "doc_id long, tag long, k1 long, k2 long, sig binary, bands array<long>"), "mhsig")
    copies = signed.where("k1 is not null and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = stage(copies, "mhcopies")  # so the join below shuffles both sides, and Spark can split a large class of copies
    keyed = signed.select("doc_id", "k1", "k2").join(copies, ["k1", "k2"], "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("copy_id"))
    keyed = stage(keyed, "mhcopy")
    own = keyed.where("doc_id = copy_id").select("doc_id").distinct()
    reps = signed.where("sig is not null").join(own, "doc_id").select(F.col("doc_id").alias("rep"), "tag", "sig", "bands").dropDuplicates(["rep", "tag"])
    bands = reps.select("rep", F.explode("bands").alias("band"))
    least = bands.groupBy("band").agg(F.min("rep").alias("lead"), F.max("rep").alias("most")).where("lead < most").select("band", "lead")
    ties = bands.join(least, "band").where("rep <> lead").select("rep", "lead").distinct()
    group = components(ties, "rep", "lead")
    group = stage(group.unionByName(group.select(F.col("root").alias("node"), "root").distinct()), "mhgroup").withColumnRenamed("node", "rep")
    bodies = text.where("text is not null").select(F.col("doc_id").alias("rep"), "tag", "text")
    full = group.join(reps.select("rep", "tag", "sig"), "rep").join(bodies, ["rep", "tag"]).select("root", "rep", "sig", "text")
    full = stage(full, "mhfull")
    links = _join_groups(full, threshold)
    joined = components(links, "a", "b")
    out = keyed.join(joined.withColumnRenamed("node", "copy_id"), "copy_id", "left")
    return out.select("doc_id", F.coalesce("root", "copy_id").alias("class_id"), "copy_id", F.coalesce(F.col("doc_id") == F.coalesce("root", "copy_id"), F.lit(True)).alias("kept"))


def op10_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: All pairs that share a shingle; the similarity by running sums in the order of the weights' ratios.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
c AS (SELECT doc_id, w, CASE WHEN len(w) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY array_to_string(w, ' ')) END AS copy_id FROM d),
p AS (SELECT doc_id, w, unnest(CASE WHEN len(w) < 5 THEN [1] ELSE range(1, len(w) - 3) END) AS i FROM c WHERE doc_id = copy_id AND len(w) > 0),
s AS (SELECT doc_id, array_to_string(w[i : i + 4], ' ') AS g, 1 + ln(count(*)) AS x FROM p GROUP BY ALL),
t AS (SELECT doc_id, sum(x) AS total FROM s GROUP BY doc_id),
b AS (SELECT l.doc_id AS a, r.doc_id AS b, l.x AS u, r.x AS v FROM s l JOIN s r ON l.g = r.g AND l.doc_id < r.doc_id),
m AS (SELECT a, b, sum(u) AS su, sum(v) AS sv FROM b GROUP BY a, b),
q AS (
  SELECT b.a, b.b, u, v, su, sv,
    sum(u) OVER (PARTITION BY b.a, b.b ORDER BY u / v DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS up,
    sum(v) OVER (PARTITION BY b.a, b.b ORDER BY u / v DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS down
  FROM b JOIN m ON m.a = b.a AND m.b = b.b),
z AS (
  SELECT q.a, q.b FROM q JOIN t x ON x.doc_id = q.a JOIN t y ON y.doc_id = q.b GROUP BY q.a, q.b
  HAVING sum(1 / ((x.total - su + up) / u + (y.total - sv + sv - down) / v)) >= 0.8),
links AS (SELECT a, b FROM z UNION ALL SELECT b, a FROM z),
reach(n, r) AS (
  SELECT DISTINCT copy_id, copy_id FROM c
  UNION
  SELECT reach.n, links.b FROM reach JOIN links ON reach.r = links.a),
k AS (SELECT n, min(r) AS class_id FROM reach GROUP BY n)
SELECT c.doc_id, k.class_id, c.copy_id, c.doc_id = k.class_id AS kept FROM c JOIN k ON k.n = c.copy_id
"""
