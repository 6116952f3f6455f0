"""Codes of vectors by product quantisation, compared in an integer Walsh-Hadamard domain.

Components become integers floor(256 x). A vector is cut into equal parts; each part is compared with its codebook's
entries through the Walsh-Hadamard transform of both, zero-padded to a power of two: the transform keeps squared
distances up to that power, as whole numbers. Squared differences are added in sequency order, slow coefficients
first; an entry leaves as soon as its sum passes the full distance of the entry that led after the first coefficient,
which the nearest entry cannot. No floating point takes part after the floor.

Codebooks are refined in rounds. Each task adds up what its rows assign to every entry, one row an entry and place, and
those rows are summed by Spark; the codebooks themselves (parts x entries x places) are all that reaches the driver.

Defined cases: a vector that is null, or holds null, NaN or infinite components, is dropped; a component beyond
+-2^31 after scaling counts as +-2^31 (a squared difference beyond it does not fit a long); vectors shorter than the
longest, and lengths that the parts do not divide, are padded with zeros at the end; an empty vector is all zeros;
ties go to the lower entry; of rows with one id the least vector seeds the codebook, all are coded; a row without an
id is coded but seeds nothing, and gets a null code if nothing seeds it; an error beyond a long is null, and with it
its label's; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256
PARTS, ENTRIES, ROUNDS = 16, 64, 2
LIMIT = 1 << 31
#: Rows that are compared with a codebook at once.
BLOCK = 2048


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int = SCALE) -> DataFrame:
    """(id, label, q array<long>) of the rows whose vectors hold numbers only; JVM only."""
    v = F.col(vector_col)
    finite = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    q = F.transform(v, lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(x.cast("double") * scale))).cast("long"))
    return vectors.where(finite).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), q.alias("q"))


def sequency_matrix(m: int) -> np.ndarray:
    """Rows of the Walsh-Hadamard matrix of order m, a power of two, by their number of sign changes."""
    h = np.ones((1, 1), np.int64)
    while len(h) < m:
        h = np.block([[h, h], [h, -h]])
    return h[np.argsort((h[:, 1:] != h[:, :-1]).sum(axis=1), kind="stable")]


def _exact(most: int, m: int) -> type:
    """64-bit integers where no sum of m squared differences can pass them, whole numbers of any size otherwise."""
    return np.int64 if m * (2 * m * most) ** 2 < 1 << 63 else object


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the entry nearest to each row of ``parts``; ties to the lower index."""
    length = parts.shape[1]
    m = 1 << max(0, length - 1).bit_length()
    most = max(int(np.abs(parts).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind, walsh = _exact(most, m), sequency_matrix(m)
    pad = ((0, 0), (0, m - length))
    a = np.pad(parts, pad).astype(kind) @ walsh.T.astype(kind)
    b = np.pad(entries, pad).astype(kind) @ walsh.T.astype(kind)
    sums = (a[:, :1] - b[:, 0]) ** 2
    lead = sums.argmin(axis=1)
    bound = ((a - b[lead]) ** 2).sum(axis=1)
    row, entry = np.nonzero(sums <= bound[:, None])
    kept = sums[row, entry]
    for k in range(1, m):
        kept = kept + (a[row, k] - b[entry, k]) ** 2
        stay = kept <= bound[row]
        if not stay.all():
            row, entry, kept = row[stay], entry[stay], kept[stay]
    # rows come in order, entries in order inside a row: the first least one of each row is the lower index
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    best = np.minimum.reduceat(kept, starts) if len(starts) else kept
    hit = np.flatnonzero(kept == np.repeat(best, np.diff(np.r_[starts, len(row)])))
    first = hit[np.unique(row[hit], return_index=True)[1]]
    return entry[first], kept[first] // m


def _matrix(column: pa.Array, length: int, parts: int) -> np.ndarray:
    """Rows x parts x places from a list column, padded with zeros to ``length``."""
    n = len(column)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((n, length), np.int64)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(n), sizes), at] = flat
    return out.reshape(n, parts, length // parts)


def _codes(column: pa.Array, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts, _, width = book.shape
    x = _matrix(column, parts * width, parts)
    code, error = np.empty((len(x), parts), np.int64), np.empty((len(x), parts), object)
    for s in range(0, len(x), BLOCK):
        for p in range(parts):
            code[s : s + BLOCK, p], error[s : s + BLOCK, p] = nearest(x[s : s + BLOCK, p], book[p])
    return x, code, error


def _totals(rows: DataFrame, book: np.ndarray) -> list:
    """(part, entry, place, sum, count) of what the rows assign to each entry, one row for each in all."""
    parts, entries, width = book.shape

    def add(batches):
        sums, counts = np.zeros((parts * entries, width), object), np.zeros(parts * entries, np.int64)
        for batch in batches:
            x, code, _ = _codes(batch.column("q"), book)
            at = (np.arange(parts) * entries + code).ravel()
            held = np.zeros((parts * entries, width), np.int64)
            np.add.at(held, at, x.reshape(-1, width))  # 2^31 times the rows of a batch fits
            sums += held
            counts += np.bincount(at, minlength=parts * entries)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(used, width)),
                pa.array(np.tile(np.arange(width), len(used))),
                pa.array([str(s) for s in sums[used].ravel()], pa.string()),
                pa.array(np.repeat(counts[used], width)),
            ],
            ["slot", "place", "s", "n"],
        )

    told = rows.select("q").mapInArrow(add, "slot long, place long, s string, n long")
    return told.groupBy("slot", "place").agg(F.sum(F.col("s").cast("decimal(38,0)")).cast("string").alias("s"), F.sum("n").alias("n")).collect()


def fit_codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (parts x entries x places) seeded by the rows of the smallest ids and refined over all rows.

    None if no row has an id. The seeds and the codebooks are bounded by entries x components.
    """
    seeds = rows.where("id IS NOT NULL").groupBy("id").agg(F.min("q").alias("q")).orderBy("id").limit(entries).collect()
    if not seeds:
        return None
    longest = rows.agg(F.max(F.size("q"))).first()[0]
    width = max(1, -(-longest // parts))
    book = _matrix(pa.array([r["q"] for r in seeds], pa.list_(pa.int64())), parts * width, parts).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        for r in _totals(rows, book):
            book[r["slot"] // len(seeds), r["slot"] % len(seeds), r["place"]] = int(r["s"]) // r["n"]
    return book


def codebook_digest(book: np.ndarray | None) -> str:
    listed = [] if book is None else book.ravel().tolist()
    return hashlib.sha256(",".join(map(str, listed)).encode()).hexdigest()


def encode(rows: DataFrame, book: np.ndarray | None) -> DataFrame:
    """(id, label, code, error) of integer vectors under fitted codebooks."""
    if book is None:
        return rows.select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    most = (1 << 63) - 1

    def code(batches):
        for batch in batches:
            _, codes, errors = _codes(batch.column("q"), book)
            told = [bytes(c).hex() for c in codes.astype(np.uint8)]
            sums = [int(e) if e <= most else None for e in errors.sum(axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(told, pa.string()), pa.array(sums, pa.int64())], ["id", "label", "code", "error"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(code, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def _label_errors(coded: DataFrame) -> DataFrame:
    total: Column = F.when(F.count("error") == F.count("*"), F.sum(F.col("error").cast("decimal(38,0)")))
    return coded.groupBy("label").agg(total.alias("__sum")).select(F.col("label").alias("__label"), F.expr("try_cast(__sum AS long)").alias("label_error"))


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Code and error of each vector, its label's error, and the digest of the codebooks."""
    rows = integer_vectors(vectors, id_col, vector_col, label_col)
    book = fit_codebooks(rows)
    coded = encode(rows, book)
    joined = coded.join(_label_errors(coded), F.col("label").eqNullSafe(F.col("__label")), "left")
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(codebook_digest(book)).alias("codebooks_sha256"))


def _round_sql(i: int) -> str:
    """SQL of one round: assign with codebook b{i}, then replace entries as b{i + 1}."""
    return f"""
a{i} AS MATERIALIZED (
  SELECT vec_id, p, arg_min(e, d * 64 + e) AS e, min(d) AS d FROM (
    SELECT x.vec_id, x.p, b.e, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts x JOIN b{i} b ON b.p = x.p) GROUP BY 1, 2),
m{i} AS (
  SELECT p, e, list(s ORDER BY k) AS v FROM (
    SELECT a.p, a.e, k, ((sum(x.v[k]) - ((sum(x.v[k]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS s
    FROM a{i} a JOIN parts x ON x.vec_id = a.vec_id AND x.p = a.p, generate_series(1, (SELECT w FROM width)) g(k) GROUP BY 1, 2, 3) GROUP BY 1, 2),
b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{i} b LEFT JOIN m{i} m ON m.p = b.p AND m.e = b.e),"""


ORACLE_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
width AS (SELECT max(len(q)) // 16 AS w FROM kept),
parts AS MATERIALIZED (SELECT vec_id, p, q[p * w + 1:(p + 1) * w] AS v FROM kept, width, generate_series(0, 15) g(p)),
seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 64),
b0 AS MATERIALIZED (SELECT p, e, v FROM seeds JOIN parts USING (vec_id)),{_round_sql(0)}{_round_sql(1)}{_round_sql(2)}
coded AS (
  SELECT vec_id, string_agg(lower(lpad(to_hex(e), 2, '0')), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY 1),
book AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, k)) AS codebooks_sha256 FROM (SELECT p, e, unnest(v) AS c, generate_subscripts(v, 1) AS k FROM b2))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), book
"""
