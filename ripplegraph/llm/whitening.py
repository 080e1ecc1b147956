"""Whitening of embeddings by an eigendecomposition that grows with the rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.llm.common import checkpointed, written
from ripplegraph.llm.rank_one import EPS, Spectrum

#: Entries become whole numbers: floor(SCALE * entry) + SHIFT, with SCALE * entry held within MOST.
SCALE, SHIFT, MOST = 64, 1_000_000, float(1 << 53)
#: Vectors that a task takes in at least, if there are so many; partial results that one task combines.
ROWS, FAN = 1024, 16

_PART = "part long, n long, sums array<decimal(38,0)>, mean array<double>, eigenvalues array<double>, vectors array<double>"
_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole(embedding: Column) -> Column:
    """The vector's entries as whole numbers."""
    held = lambda c: F.greatest(F.least(c.cast("double") * SCALE, F.lit(MOST)), F.lit(-MOST))
    return F.transform(embedding, lambda c: F.floor(held(c)).cast("long") + SHIFT)


def usable(df: DataFrame) -> DataFrame:
    """vec_id, x: the rows whose vector is neither null nor holds nulls, NaN or infinities."""
    e = F.col("embedding")
    good = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))
    return df.where(e.isNotNull() & F.forall(e, good)).select(F.col("vec_id").cast("long").alias("vec_id"), whole(e).alias("x"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _exact(x: np.ndarray, factor: int) -> np.ndarray:
    """The numbers as they are, or as Python's where so many of them could pass 64 bits."""
    return x.astype(object) if int(np.abs(x).max(initial=0)) * factor >= 1 << 61 else x


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n times each vector, minus the sums: exact."""
    x = _exact(x, max(1, n))
    return x * n - np.array(sums, dtype=object if x.dtype == object or max(map(abs, sums)) >= 1 << 61 else np.int64)


def _batches(batches):
    for b in batches:
        if b.num_rows:
            yield b, _matrix(b.column("x"))


def spectra(fit: DataFrame) -> DataFrame:
    """One row for each partition of ``fit`` (x): its sums, and the eigenpairs of its squares about its mean."""

    def run(batches):
        spectrum = sums = None
        for _, x in _batches(batches):
            if spectrum is None:
                spectrum, sums = Spectrum(x.shape[1]), [0] * x.shape[1]
            sums = [a + int(b) for a, b in zip(sums, _exact(x, len(x)).sum(axis=0), strict=True)]
            for row in x.astype(float):
                spectrum.add(row)
        if spectrum:
            part = {"part": TaskContext.get().partitionId(), "n": spectrum.n, "sums": sums, "mean": spectrum.mean, "eigenvalues": spectrum.values, "vectors": spectrum.vectors.ravel()}
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.decimal128(38, 0)), *[pa.list_(pa.float64())] * 3]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(part.values(), kinds, strict=True)], names=list(part))

    return fit.mapInArrow(run, _PART)


def _folded(parts: DataFrame, fold):
    """The one row that is left when FAN neighbours at a time are folded, in the order of their partitions."""

    def of(key, pdf):
        pdf = pdf.sort_values("part")
        return fold(pdf).assign(part=key[0])

    parts = checkpointed(parts)
    while parts.agg(F.max("part")).first()[0]:
        parts = checkpointed(parts.groupBy(F.floor(F.col("part") / FAN).alias("_next")).applyInPandas(of, parts.schema))
    return parts.first()


def _merged(pdf):
    spectra_ = []
    for row in pdf.itertuples():
        s = Spectrum(len(row.mean))
        s.n, s.mean, s.values, s.vectors = row.n, np.array(row.mean), np.array(row.eigenvalues), np.array(row.vectors).reshape(len(row.mean), -1)
        spectra_.append(s)
    one = spectra_[0]
    for s in spectra_[1:]:
        one.merge(s)
    out = pdf.iloc[[0]].copy()
    sums = [sum(x) for x in zip(*pdf["sums"], strict=True)]
    for name, value in (("n", one.n), ("sums", sums), ("mean", one.mean), ("eigenvalues", one.values), ("vectors", one.vectors.ravel())):
        out[name] = [value]
    return out


def _added(pdf):
    return pdf.iloc[[0]].assign(total=[np.sum(np.stack(pdf["total"]), axis=0)])


def squares(fit: DataFrame, n: int, sums: list[int], onto: np.ndarray) -> np.ndarray:
    """The covariance over ``fit`` of its centred vectors times ``onto``, summed by partitions."""

    def run(batches):
        total = None
        for _, x in _batches(batches):
            y = (_centred(x, n, sums).astype(float) / n) @ onto
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.ravel()], pa.list_(pa.float64()))], names=["part", "total"])

    row = _folded(fit.mapInArrow(run, "part long, total array<double>"), _added)
    return np.array(row["total"]).reshape(onto.shape[1], -1) / n


def components(fit: DataFrame) -> tuple[int, list[int], np.ndarray, np.ndarray, float]:
    """n, the sums, the positive eigenvalues of the covariance, falling, their unit eigenvectors as columns, the trace.

    Each partition's eigenpairs grow by one centred rank-one term a vector; partitions are combined
    a few at a time, by rank-one terms again. The outcome is the basis in which a last pass takes
    the covariance (Rayleigh-Ritz), which makes up for the rounding of all updates. What the
    driver holds grows with the square of the dimensions, not with rows.
    """
    row = _folded(spectra(fit), _merged)
    n, sums = row["n"], [int(s) for s in row["sums"]]
    basis, _ = np.linalg.qr(np.array(row["vectors"]).reshape(len(sums), -1))
    inner = squares(fit, n, sums, basis)
    values, turned = np.linalg.eigh((inner + inner.T) / 2)
    vectors = basis @ turned
    order = np.argsort(-values, kind="stable")
    order = order[values[order] > 8 * EPS * len(sums) * max(values.max(), 0)]
    vectors = vectors[:, order] / np.linalg.norm(vectors[:, order], axis=0)
    vectors *= np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1, 1)
    return n, sums, values[order], vectors, float(np.trace(inner))


def whitened(df: DataFrame, most: int = 16) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: up to ``most`` rows for each vector.

    Rows whose vector is null or has null or non-finite entries are left out; so are those whose
    vector is not as long as most are (of lengths that are equally common, the longest counts).
    Each distinct vector of whole numbers is fitted once; repeated rows, and null ids, each get
    their rows of the result. Components without variance are not returned, so that one distinct
    vector, empty vectors and empty tables give no rows. Entries past 2 ** 53 / 64 count as that
    bound; a deviation that passes 64 bits is null. Other columns are unread, whatever their names.
    """
    spark = df.sparkSession
    rows = usable(df)
    length = rows.groupBy(F.size("x").alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
    if length is None or not length["length"]:
        return spark.createDataFrame([], _OUT)
    rows = rows.where(F.size("x") == length["length"])
    fit = written(rows.select("x").distinct())
    tasks = min(-(-fit.count() // ROWS), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    fit = written(fit.repartition(tasks, "x").sortWithinPartitions("x"))
    n, sums, values, vectors, trace = components(fit)
    values, vectors = values[:most], vectors[:, :most]
    k = len(values)
    if not k:
        return spark.createDataFrame([], _OUT)
    onto = vectors / np.sqrt(values)
    error = float(np.abs(squares(fit, n, sums, onto) - np.eye(k)).max())
    shares = values / trace

    def run(batches):
        for b, x in _batches(batches):
            apart = _centred(x, n, sums)
            made = (apart.astype(float) / n) @ onto
            wide = _exact(apart, 1)
            if int(np.abs(wide).max()) ** 2 * len(sums) >= 1 << 63:
                wide = wide.astype(object)
            deviation = pa.array([d if d < 1 << 63 else None for d in (wide * wide).sum(axis=1).tolist()], pa.int64())
            at, m = np.repeat(np.arange(len(x)), k), len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("vec_id").take(pa.array(at)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n)),
                    deviation.take(pa.array(at)),
                    pa.array(made.ravel()),
                    pa.array(np.tile(shares, m)),
                    pa.array(np.full(m * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, _OUT)
