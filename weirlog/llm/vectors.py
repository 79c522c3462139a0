"""Embedding near-duplicates by product quantisation: inverted lists, residual codes, table-lookup distances, exact rerank."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shipping import ship
from .common import components, dimension, same, stage

COSINE = 0.93
#: Centroids and codebooks are trained on at most this many vectors, by the order of a hash of their ids.
SAMPLE = 20_000
MAX_LISTS, PROBES, PARTS, CODES = 1_024, 10, 8, 64
#: Rows of one side of a unit of work; longer lists are compared block by block.
BLOCK = 2_048


@dataclass(frozen=True)
class Quantiser:
    """Coarse centroids (lists, d), and for each of the parts of a residual its codebook (parts, codes, d / parts)."""

    centroids: np.ndarray
    books: np.ndarray
    edges: tuple[int, ...]

    def home(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The nearest lists of unit vectors, nearest first."""
        s = x @ self.centroids.T
        k = min(probes, s.shape[1])
        near = np.argpartition(-s, k - 1, axis=1)[:, :k]
        order = np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable")
        return np.take_along_axis(near, order, 1)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, length of what the codes leave out) of residuals to the lists' centroids."""
        r = x - self.centroids[lists]
        codes = np.empty((len(x), len(self.books)), dtype=np.uint8)
        left = np.zeros(len(x))
        for m, book in enumerate(self.books):
            part = r[:, self.edges[m] : self.edges[m + 1]]
            book = book[:, : part.shape[1]]
            d = (part**2).sum(1)[:, None] - 2 * part @ book.T + (book**2).sum(1)[None, :]
            codes[:, m] = d.argmin(1)
            left += np.maximum(d.min(1), 0)
        return codes, np.sqrt(left)

    def tables(self, x: np.ndarray) -> np.ndarray:
        """(queries, parts, codes): inner products of queries' parts with the codebooks."""
        return np.stack([x[:, self.edges[m] : self.edges[m + 1]] @ b[:, : self.edges[m + 1] - self.edges[m]].T for m, b in enumerate(self.books)], axis=1)


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int, spherical: bool) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = (2 * x @ c.T - (c**2).sum(1)).argmax(1)
        n = np.bincount(at, minlength=len(c))
        new = np.zeros_like(c)
        np.add.at(new, at, x)
        c = np.where(n[:, None] > 0, new / np.maximum(n, 1)[:, None], c)
        if spherical:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(x: np.ndarray, lists: int, parts: int = PARTS, codes: int = CODES) -> Quantiser:
    """Train on unit vectors x."""
    centroids = _kmeans(x, lists, 10, 1, True)
    at = (x @ centroids.T).argmax(1)
    r = x - centroids[at]
    d = x.shape[1]
    parts = max(1, min(parts, d))
    edges = tuple(round(i * d / parts) for i in range(parts + 1))
    width = max(b - a for a, b in zip(edges, edges[1:], strict=False))
    books = np.zeros((parts, min(codes, len(x)), width))
    for m in range(parts):
        books[m, :, : edges[m + 1] - edges[m]] = _kmeans(r[:, edges[m] : edges[m + 1]], codes, 8, 2 + m, False)
    return Quantiser(centroids, books, edges)


def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    # scale first: squares of very large or very small components must not overflow or vanish
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes of doubles; null where one cannot link."""
    for batch in batches:
        out = []
        for v, label in zip(batch.column(2), batch.column(1), strict=True):
            raw = None
            if v.is_valid and label.is_valid and len(v.values):
                a = np.asarray(v.values.to_numpy(zero_copy_only=False), dtype=np.float64)
                if v.values.null_count == 0 and np.isfinite(a).all() and a.any():
                    raw = (a + 0.0).tobytes()
            out.append(raw)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["vec_id", "label", "v"])


def _matrix(column: list[bytes]) -> np.ndarray:
    return _unit(np.frombuffer(b"".join(column), dtype=np.float64).reshape(len(column), -1))


def _assign(batches: Iterator[pa.RecordBatch], models: dict[int, Quantiser], probes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        by: dict[int, list[dict]] = {}
        for r in rows:
            by.setdefault(len(r["v"]), []).append(r)
        for size, group in sorted(by.items()):
            model = models.get(size)
            for r in group:
                r["size"] = size
            if model is None:  # a length that the sample did not hold: one list, compared exactly
                for r in group:
                    r |= {"probes": [0], "code": b"", "left": 0.0}
            else:
                x = _matrix([r["v"] for r in group])
                near = model.home(x, probes)
                codes, left = model.encode(x, near[:, 0])
                for r, p, c, e in zip(group, near.tolist(), codes, left.tolist(), strict=True):
                    r |= {"probes": p, "code": c.tobytes(), "left": e}
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("label", batch.schema.field("label").type), ("v", pa.binary()), ("size", pa.int32()), ("probes", pa.list_(pa.int32())), ("code", pa.binary()), ("left", pa.float64())]))


def _links(base: list[dict], query: list[dict] | None, model: Quantiser | None, cell: int, least: float) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """(links by representative, links that join all linked) between base and query rows, or within base if query is None."""
    y = _matrix([r["v"] for r in base])
    inner = query is None
    rows = base if inner else query
    x = y if inner else _matrix([r["v"] for r in rows])
    counts: dict[int, int] = {}
    forest: list[tuple[int, int]] = []
    up = {}

    def root(a: int) -> int:
        while up.setdefault(a, a) != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    if model is not None:
        codes = np.frombuffer(b"".join(r["code"] for r in base), dtype=np.uint8).reshape(len(base), -1)
        left = np.array([r["left"] for r in base])
        lists = np.array([r["probes"][0] for r in base])
        visits = [set(r["probes"]) for r in base]
    weight = np.array([r["n"] for r in rows]), np.array([r["n"] for r in base])
    for first in range(0, len(rows), 256):
        q = x[first : first + 256]
        if model is not None:
            table = model.tables(q)
            guess = q @ model.centroids[lists].T
            for m in range(codes.shape[1]):
                guess += table[:, m, :][:, codes[:, m]]
            i, j = np.nonzero(guess >= least - left[None, :] - 1e-9)
        else:
            i, j = (a.ravel() for a in np.indices((len(q), len(base))))
        if inner:
            ok = i + first < j
            i, j = i[ok], j[ok]
        if not len(i):
            continue
        if len(i) * 4 > len(q) * len(base):
            exact = (q @ y.T)[i, j]
        else:
            exact = np.einsum("ij,ij->i", q[i], y[j])
        # sums that fall this near the limit are taken again, one by one, in a fixed order
        close = np.flatnonzero(np.abs(exact - least) < 1e-9)
        for k in close:
            exact[k] = math.fsum(q[i[k]] * y[j[k]])
        ok = exact >= least
        for a, b in zip((i[ok] + first).tolist(), j[ok].tolist(), strict=True):
            r, s = rows[a], base[b]
            if not inner:
                mine = r["probes"][0]
                if model is not None and mine in visits[b] and mine < cell:
                    continue  # this pair is counted in the query's own list
            counts[r["rep"]] = counts.get(r["rep"], 0) + int(weight[1][b])
            counts[s["rep"]] = counts.get(s["rep"], 0) + int(weight[0][a])
            u, v = root(r["rep"]), root(s["rep"])
            if u != v:
                up[max(u, v)] = min(u, v)
                forest.append((r["rep"], s["rep"]))
    return counts, forest


def _search(batches: Iterator[pa.RecordBatch], models: dict[int, Quantiser], least: float) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by unit; one unit, at most two blocks, is held at a time."""
    unit, rows = None, []

    def out() -> pa.RecordBatch:
        _, size, cell, kind, i, j = unit
        model = models.get(size)
        if kind == "h":
            left, right = [r for r in rows if r["block"] == i], [r for r in rows if r["block"] == j]
            counts, forest = _links(left, None if i == j else right, model, cell, least) if left and right else ({}, [])
        else:
            left, right = [r for r in rows if r["is_home"]], [r for r in rows if not r["is_home"]]
            counts, forest = _links(left, right, model, cell, least) if left and right else ({}, [])
        a = [*counts, *(f[0] for f in forest)]
        n = [*counts.values(), *[0] * len(forest)]
        b = [*[None] * len(counts), *(f[1] for f in forest)]
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(n, pa.int64()), pa.array(b, pa.int64())], names=["a", "n", "b"])

    for batch in batches:
        for r in batch.to_pylist():
            key = (r["label"], r["size"], r["cell"], r["kind"], r["i"], r["j"])
            if key != unit:
                if len(rows) > 1:
                    yield out()
                unit, rows = key, []
            rows.append(r)
    if len(rows) > 1:
        yield out()


def vector_links(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    cosine: float = COSINE, sample: int = SAMPLE, probes: int = PROBES,
) -> DataFrame:
    """Links between vectors of one label with a cosine of at least `cosine`, and their components.

    Equal vectors of a label become one class first. A quantiser is trained on a bounded sample; every class goes into
    the inverted list of its nearest centroid and visits the next ones. In a list, distances are estimated from
    residual codes by table lookup; since the length that a code leaves out is stored, no pair of the list that reaches
    the limit is missed. What passes is computed exactly in double precision. Pairs are counted where they are found:
    a unit of work returns link counts and joining links only. Lists longer than BLOCK are compared block by block.

    Vectors that are null, empty, zero or hold null or non-finite components, and vectors without a label, link with
    nothing. Vectors of different lengths do not link. Null ids: no links, own row. Rows that repeat an id are
    vectors of their own, each with its row, whether their vectors are equal or not. Empty table: no rows. Other columns are not read.
    Returns (vec_id, n_links, component_id, kept).
    """
    spark = vectors.sparkSession
    ship(spark)
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    kind = v.schema["label"].dataType.simpleString()
    base = stage(v.mapInArrow(_clean, f"vec_id long, label {kind}, v binary").withColumn("nth", F.monotonically_increasing_id()), "pqbase")
    good = base.where("v is not null and vec_id is not null")
    # a class goes by its first row's number: ids may repeat
    classes = stage(good.groupBy("label", "v").agg(F.min("nth").alias("rep"), F.min("vec_id").alias("least"), F.count("*").alias("n")), "pqclass")
    total = classes.count()
    picked: dict[int, list[bytes]] = {}
    for r in classes.orderBy(F.xxhash64(F.lit(3), "least"), "least", "v").limit(sample).select("v").collect():
        picked.setdefault(len(r["v"]), []).append(bytes(r["v"]))
    lists = max(1, min(MAX_LISTS, math.isqrt(total) // 2))
    models = {size: fit(_matrix(rows), lists) for size, rows in picked.items() if len(rows) >= 2 * CODES}
    shared = spark.sparkContext.broadcast(models)
    schema = f"rep long, n long, label {kind}, v binary, size int, probes array<int>, code binary, left double"
    assigned = classes.select("rep", "n", "label", "v").mapInArrow(lambda it: _assign(it, shared.value, probes), schema)
    spread = stage(assigned.select("*", F.posexplode("probes").alias("turn", "cell")).withColumn("is_home", F.col("turn") == 0).drop("turn"), "pqlists")
    size = spread.groupBy("label", "size", "cell").agg(F.ceil(F.count_if("is_home") / BLOCK).cast("int").alias("hb"), F.ceil(F.count_if(~F.col("is_home")) / BLOCK).cast("int").alias("vb"))
    size = stage(size.where("hb > 0"), "pqsize").select(F.col("label").alias("d_label"), F.col("size").alias("d_size"), F.col("cell").alias("d_cell"), "hb", "vb")
    dim = dimension(size)
    at = spread.join(dim, same(spread, dim, "label", "size", "cell")).drop("d_label", "d_size", "d_cell")
    at = at.withColumn("block", F.pmod(F.xxhash64("rep"), F.when(F.col("is_home"), F.col("hb")).otherwise(F.greatest("vb", F.lit(1)))).cast("int"))
    step = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    with_home = F.transform(step(F.col("hb")), lambda o: F.struct(F.lit("h").alias("kind"), F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    as_base = F.transform(step(F.col("vb")), lambda o: F.struct(F.lit("v").alias("kind"), F.col("block").alias("i"), o.alias("j")))
    as_guest = F.transform(step(F.col("hb")), lambda o: F.struct(F.lit("v").alias("kind"), o.alias("i"), F.col("block").alias("j")))
    units = at.select("rep", "n", "label", "v", "size", "probes", "code", "left", "cell", "is_home", "block", F.explode(F.when(F.col("is_home"), F.concat(with_home, as_base)).otherwise(as_guest)).alias("u"))
    key = ["label", "size", "cell", "kind", "i", "j"]
    units = units.select("rep", "n", "label", "v", "size", "probes", "code", "left", "cell", "is_home", "block", "u.kind", "u.i", "u.j")
    found = units.repartition(*key).sortWithinPartitions(*key).mapInArrow(lambda it: _search(it, shared.value, cosine), "a long, n long, b long")
    found = stage(found, "pqfound")
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    joined = components(found.where("b is not null"), "a", "b").withColumnRenamed("node", "rep")
    named = classes.join(counts, "rep", "left").join(joined, "rep", "left")
    named = named.select(F.col("label").alias("d_label"), F.col("v").alias("d_v"), F.coalesce("root", "rep").alias("root"), "least", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("links"), "n", "rep")
    named = stage(named.where("n > 1 or links > 0"), "pqnamed")
    least = stage(named.groupBy(F.col("root").alias("d_root")).agg(F.min("least").alias("component")), "pqleast")
    named = named.join(least, F.col("root") == F.col("d_root"))
    # rows of classes with copies find their class by the vector, the others by their number
    many, one = named.where("n > 1"), named.where("n = 1").select(F.col("rep").alias("d_nth"), F.col("component").alias("c1"), F.col("links").alias("n1"))
    rows = base.withColumn("usable", F.col("v").isNotNull() & F.col("vec_id").isNotNull())
    many = many.select("d_label", "d_v", F.col("component").alias("c2"), F.col("links").alias("n2"))
    rows = rows.join(many, (rows["label"] == many["d_label"]) & (rows["v"] == many["d_v"]) & rows["usable"], "left")
    rows = rows.join(one, (rows["nth"] == one["d_nth"]) & rows["c2"].isNull(), "left")
    component = F.coalesce("c2", "c1", "vec_id")
    return rows.select("vec_id", F.coalesce("n2", "n1", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op3_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH RECURSIVE ok AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding::DOUBLE[], lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(v, r) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT reach.v, links.b FROM reach JOIN links ON reach.r = links.a),
parts AS (SELECT v, min(r) AS component_id FROM reach GROUP BY v),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, p.component_id, e.vec_id = p.component_id AS kept
FROM embeddings e JOIN parts p ON p.v = e.vec_id LEFT JOIN counts c ON c.a = e.vec_id
"""
