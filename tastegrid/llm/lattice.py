"""Near-duplicate vectors by lattice hashing.

In each of ``tables`` tables a random orthonormal projection takes a unit vector to eight dimensions, where the nearest
point of the E8 lattice is its cell. A vector is stored under its cell and asks for it and for the ``probes``
neighbouring cells that lie nearest, in every table. Pairs that meet are screened by 64 sign bits (a pair at the
threshold differs in about 8 of them; beyond 24 it is let go) and verified by cosine in double precision.

With the defaults a pair at cosine 0.93 is found with probability above 0.99, a closer one almost surely. Equal vectors
are one class before the search. Defined results: a null label, a null or zero vector, or one with null or non-finite
components, links with nothing and keeps its own id; vectors of different lengths never link; each row counts as a
vector, also rows that share an id; a null id represents nothing, and its component is that of its class, if any;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tastegrid.llm.graph import components
from tastegrid.operators.staging import stage

SCREEN = 24  # most differing sign bits of a candidate


def shortest_vectors() -> np.ndarray:
    """The 240 lattice vectors of length sqrt(2)."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: round, and where the sum is odd round the worst coordinate the other way."""
    near = np.rint(x)
    rows = np.flatnonzero(near.sum(1) % 2 != 0)
    worst = np.abs(x - near)[rows].argmax(1)
    near[rows, worst] += np.where((x - near)[rows, worst] >= 0, 1.0, -1.0)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1)
    return np.where(closer[:, None], whole, half)


def _name(cells: np.ndarray) -> np.ndarray:
    """Eight doubled coordinates as the bytes of one long."""
    return np.ascontiguousarray(np.clip(cells * 2, -128, 127).astype(np.int8)).view(np.int64)[..., 0]


def cells(unit: np.ndarray, tables: int, scale: float, probes: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells ``(n, tables)``, the cells asked for ``(n, tables, 1 + probes)`` and sign bits ``(n,)`` of unit rows."""
    n, dim = unit.shape
    rng = np.random.default_rng([seed, dim])
    around, own, asked = shortest_vectors(), [], []
    for _ in range(tables):
        axes = np.linalg.qr(rng.normal(size=(max(dim, 8), 8)))[0][:dim]
        x = unit @ axes * (scale * np.sqrt(dim / 64))
        c = nearest_e8(x)
        order = np.argsort(-((x - c) @ around.T), axis=1, kind="stable")[:, :probes]
        own.append(_name(c))
        asked.append(_name(np.concatenate((c[:, None], c[:, None] + around[order]), axis=1)))
    signs = (unit @ rng.normal(size=(dim, 64)) > 0).astype(np.uint8)
    bits = np.ascontiguousarray(np.packbits(signs, axis=1)).view(np.int64)[:, 0]
    return np.stack(own, 1), np.stack(asked, 1), bits


def _coded(classes: DataFrame, tables: int, scale: float, probes: int, seed: int) -> DataFrame:
    """``(rep, grp, dim, bits, norm, unit, own, asked)`` of the classes whose vectors can link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[int, list] = {}
            for i, v in enumerate(batch.column(2).to_pylist()):
                if v and None not in v:
                    x = np.array(v, np.float64)
                    top = np.abs(x).max()
                    if np.isfinite(top) and top > 0:
                        x = x / top
                        rows.setdefault(len(v), []).append((i, x / np.sqrt(x @ x)))
            for dim, found in rows.items():
                unit = np.array([x for _, x in found])
                at = pa.array([i for i, _ in found])
                own, asked, bits = cells(unit, tables, scale, probes, seed)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(at), batch.column(1).take(at), pa.array(np.full(len(found), dim)), pa.array(bits),
                        pa.array(list(unit), pa.list_(pa.float64())), pa.array(list(own), pa.list_(pa.int64())),
                        pa.array([x.tolist() for x in asked], pa.list_(pa.list_(pa.int64()))),
                    ],
                    names=["rep", "grp", "dim", "bits", "unit", "own", "asked"],
                )

    kinds = {f.name: f.dataType.simpleString() for f in classes.schema}
    return classes.select("rep", "grp", "vec").mapInArrow(
        run,
        f"rep {kinds['rep']}, grp {kinds['grp']}, dim bigint, bits bigint, unit array<double>, own array<bigint>, asked array<array<bigint>>",
    )


def links(coded: DataFrame, threshold: float) -> DataFrame:
    """Verified pairs ``(a, b)``, each once."""
    same = ["grp", "dim", "tbl", "cell"]
    stored = coded.select(F.col("rep").alias("b"), F.col("bits").alias("bits_b"), "grp", "dim", F.posexplode("own").alias("tbl", "cell"))
    asked = coded.select(F.col("rep").alias("a"), F.col("bits").alias("bits_a"), "grp", "dim", F.posexplode("asked").alias("tbl", "list"))
    asked = asked.select("a", "bits_a", "grp", "dim", "tbl", F.explode("list").alias("cell"))
    screen = F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits_b"))) <= SCREEN
    met = asked.alias("l").join(
        stored.alias("r"), [F.col(f"l.{c}") == F.col(f"r.{c}") for c in same] + [screen, F.col("a") != F.col("b")]
    )
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = coded.select(F.col("rep").alias("a"), F.col("unit").alias("x"))
    right = coded.select(F.col("rep").alias("b"), F.col("unit").alias("y"))
    cosine = F.aggregate(F.zip_with("x", "y", lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    return pairs.join(left, "a").join(right, "b").where(cosine >= threshold).select("a", "b")


def near_vectors(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", group: str = "label", threshold: float = 0.93,
    tables: int = 6, scale: float = 8.0, probes: int = 24, seed: int = 11,
) -> DataFrame:
    """``(key, n_links, component_id, kept)``, one row per vector; only vectors of one ``group`` link."""
    rows = vectors.select(
        key, F.col(group).alias("grp"), F.col(vector).alias("vec"),
        F.xxhash64(group, vector).alias("h1"), F.xxhash64(F.lit("second"), vector, group).alias("h2"),
    )
    of = ["h1", "h2"]  # names a class of equal vectors
    classes = rows.where(F.col("grp").isNotNull() & F.col("vec").isNotNull()).groupBy(*of).agg(
        F.min(key).alias("rep"), F.count(F.lit(1)).alias("size"), F.first("grp").alias("grp"), F.first("vec").alias("vec")
    )
    classes = stage(classes.where(F.col("rep").isNotNull()), "vector-classes")
    coded = stage(_coded(classes, tables, scale, probes, seed), "vector-cells")
    # ids shared by several classes tie them; links are between ids
    found = stage(links(coded, threshold), "vector-links")
    both = found.select(F.col("a").alias("rep"), F.col("b").alias("other")).union(found.select("b", "a"))
    sizes = classes.join(coded.select("rep", "grp"), ["rep", "grp"], "left_semi").groupBy("rep").agg(F.sum("size").alias("size"))
    near = both.join(sizes.withColumnRenamed("rep", "other"), "other").groupBy("rep").agg(F.sum("size").alias("near"))
    roots = components(found).select(F.col("node").alias("rep"), "root")
    usable = coded.select("rep").distinct().withColumn("usable", F.lit(True))
    known = (
        classes.select(*of, "rep", "size")
        .join(near, "rep", "left").join(roots, "rep", "left").join(usable, "rep", "left")
        .select(
            *of,
            F.when(F.col("usable"), F.coalesce("near", F.lit(0)) + F.col("size") - 1).alias("n_links"),
            F.when(F.col("usable"), F.coalesce("root", "rep")).alias("component_id"),
        )
    )
    out = rows.select(key, *of).join(known, of, "left")
    component = F.coalesce("component_id", key)
    return out.select(
        key,
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col(key) == component, F.lit(False)).alias("kept"),
    )
