"""Product codes of vectors: integer codebooks, learnt by rounds of exact Lloyd steps.

A vector is cut into equal consecutive parts, and each part is replaced by the number of the nearest entry
in its position's codebook. The codebooks, of bounded size (parts * entries integer vectors), are broadcast;
Arrow batches compute the distances to all entries by |x|^2 - 2 x.c + |c|^2 with int64 matrix products, and
the first least one is the code. A task adds up its own parts by entry, and a grouped shuffle merges at most
one row a task and entry, so neither a round's traffic nor the driver's share grows with the vectors.

Defined results: vectors that are null, or hold a null or non-finite component, take no part. Vectors of
other lengths count as if zeros followed, up to the longest one's length and on to a multiple of the parts
(one component a part at least).
Rows that repeat are kept each; the first codebooks are of the least keys, ties by vector, null keys last.
No vectors give no rows. Distances that could leave 64 bits raise an error. Other columns are never read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import drop_table, map_batches, table, write_table
from tidemark.llm.vectors import extent, integers, matrix
from tidemark.operators.joins import with_group

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code and squared distance by row and part; x: rows by width, books: parts by entries by part width, both int64."""
    x = x.reshape(len(x), len(books), -1)
    codes, errors = (np.empty((len(x), len(books)), np.int64) for _ in range(2))
    for p, book in enumerate(books):
        part = x[:, p]
        away = (part * part).sum(1)[:, None] - 2 * (part @ book.T) + (book * book).sum(1)
        codes[:, p] = away.argmin(1)  # the first of equals
        errors[:, p] = away[np.arange(len(x)), codes[:, p]]
    return codes, errors


def learn(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts by entries by part width) of vectors (key, v)."""
    spark = rows.sparkSession
    count, width, most = extent(rows)
    size = max(1, -(-width // parts))
    if 4 * size * parts * most * most >= 2**63 or count * most >= 2**63:
        raise OverflowError("a distance or a sum does not fit 64 bits")
    first = rows.orderBy(F.col("key").asc_nulls_last(), "v").limit(entries).collect()  # a codebook
    books = np.zeros((parts, len(first), size), np.int64)
    for n, r in enumerate(first):
        flat = np.zeros(parts * size, np.int64)
        flat[: len(r.v)] = r.v
        books[:, n] = flat.reshape(parts, size)

    for _ in range(rounds if len(first) else 0):
        told = spark.sparkContext.broadcast(books)

        def add(batches, told=told):
            books = told.value
            n, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
            for batch in batches:
                x = matrix(batch.column(0), parts * size)
                codes, _ = nearest(x, books)
                for p in range(parts):
                    n[p] += np.bincount(codes[:, p], minlength=books.shape[1])
                    np.add.at(sums[p], codes[:, p], x[:, p * size : (p + 1) * size])
            part, entry = np.nonzero(n)
            if len(part):
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(n[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "s"])

        found = rows.select("v").mapInArrow(add, "part long, entry long, n long, s array<long>")
        total = F.array(*[F.sum(F.col("s")[i]) for i in range(size)])
        after = books.copy()
        for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), total.alias("s")).collect():  # at most a row an entry
            after[r.part, r.entry] = np.array(r.s, np.int64) // r.n
        told.unpersist()
        books = after
    return books


def codes(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """Vectors (key, v, ...) as key, ..., code (two hex digits a part) and error (squared distance)."""
    told = rows.sparkSession.sparkContext.broadcast(books)
    rest = [c for c in rows.columns if c != "v"]

    def encode(batch):
        books = told.value
        found, errors = nearest(matrix(batch.column(len(rest)), books.shape[0] * books.shape[2]), books)
        code = [c.astype(np.uint8).tobytes().hex() for c in found]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(code, pa.string()), pa.array(errors.sum(1))], [*rest, "code", "error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "v")
    return map_batches(rows.select(*rest, "v"), encode, f"{schema}, code string, error long")


def decode(code: str, books: np.ndarray) -> np.ndarray:
    """The integer vector that a code stands for."""
    return np.concatenate([books[p, c] for p, c in enumerate(bytes.fromhex(code))])


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, with commas between."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """key, code, error, label_error (the error of all rows of the label, null labels together) and codebooks_sha256.

    Sums by label are aggregated before they move, and a label with very many rows meets its sum in parts.
    """
    vectors = write_table(integers(rows, vector, SCALE, key=F.col(key), label=F.col(label)), "vectors")
    books = learn(vectors.select("key", "v"))
    known = F.when(F.col("label").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("label").cast("string")))
    coded = write_table(codes(vectors.select("key", known.alias("label"), "v"), books), "codes")
    drop_table(vectors)
    out = with_group(coded, "label", coded.count(), label_error=F.sum("error"))
    return out.select(F.col("key").alias(key), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def _oracle(size: int) -> str:
    """The rounds unrolled, for vectors of PARTS * size components."""
    away = f"min(list_sum([(p.x[i] - c.x[i]) * (p.x[i] - c.x[i]) for i in range(1, {size + 1})])::BIGINT * {ENTRIES} + entry)"
    sums = ", ".join(f"floor(sum(x[{i + 1}]) / count(*))::BIGINT" for i in range(size))
    steps = [f"""k AS MATERIALIZED (SELECT vec_id, label, v, row_number() OVER (ORDER BY vec_id, v) AS rn FROM (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
    p AS MATERIALIZED (SELECT rn, part, v[part * {size} + 1 : part * {size} + {size}] AS x FROM k, range({PARTS}) AS r(part)),
    c0 AS MATERIALIZED (SELECT part, rn - 1 AS entry, x FROM p WHERE rn <= {ENTRIES})"""]  # fmt: skip
    for n in range(ROUNDS + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT rn, part, {away} AS m FROM p JOIN c{n} c USING (part) GROUP BY rn, part)")
        if n < ROUNDS:
            steps.append(f"s{n} AS MATERIALIZED (SELECT part, m % {ENTRIES} AS entry, [{sums}] AS x FROM a{n} JOIN p USING (rn, part) GROUP BY ALL)")
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT part, entry, coalesce(s.x, c.x) AS x FROM c{n} c LEFT JOIN s{n} s USING (part, entry))")
    steps.append(f"""e AS (SELECT rn, string_agg(printf('%02x', m % {ENTRIES}), '' ORDER BY part) AS code, sum(m // {ENTRIES})::BIGINT AS error FROM a{ROUNDS} GROUP BY rn),
    h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{ROUNDS})""")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM k JOIN e USING (rn), h"


QUERIES = {"op11_vector_codes": op11_vector_codes}
#: For vectors of 64 components, as the table's are.
ORACLES = {"op11_vector_codes": _oracle(16)}
