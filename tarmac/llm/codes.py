"""Vectors as four one-byte codes: codebooks fitted by rounds of assignment and integer means, in exact arithmetic.

A vector's components become integers. Blocks of rows keep, for each dimension, a dictionary of its distinct
integers and the rows' positions in it. In a round a task tabulates the squared differences of each dictionary
value to the dimension's component of all codebook entries, once for each block; the distance of a row's part to
every entry is then the sum of rows gathered from these tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import query, table
from tarmac.session import stage

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
BLOCK_ROWS = 4096
_WIDEST = 1 << 26  # integers beyond +-this could overflow the exact sums


def edges(dim: int, parts: int) -> list[int]:
    """Where the parts of a vector begin and end; equal parts wherever `parts` divides its length."""
    return [dim * p // parts for p in range(parts + 1)]


class Block:
    """Rows of one block, coded by the dictionaries of their dimensions."""

    def __init__(self, ints: np.ndarray) -> None:
        self.rows, self.dim = ints.shape
        self.words, self.codes = [], np.empty((self.dim, self.rows), np.uint16)
        for d in range(self.dim):
            found, self.codes[d] = np.unique(ints[:, d], return_inverse=True)
            self.words.append(found)

    def pack(self) -> bytes:
        sizes = np.array([self.rows, self.dim, *map(len, self.words)], "<i4")
        return b"".join([sizes.tobytes(), *(w.astype("<i4").tobytes() for w in self.words), self.codes.astype("<u2").tobytes()])

    @classmethod
    def unpack(cls, raw: bytes) -> Block:
        self = cls.__new__(cls)
        self.rows, self.dim = (int(x) for x in np.frombuffer(raw, "<i4", 2))
        sizes = np.frombuffer(raw, "<i4", self.dim, 8)
        words = np.frombuffer(raw, "<i4", int(sizes.sum()), 8 + 4 * self.dim).astype(np.int64)
        self.words = np.split(words, np.cumsum(sizes)[:-1]) if self.dim else []
        self.codes = np.frombuffer(raw, "<u2", offset=8 + 4 * (self.dim + len(words))).reshape(self.dim, self.rows)
        return self

    def nearest(self, books: list[np.ndarray], at: list[int], step: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """(rows x parts: entry, squared distance); the lower entry wins a tie."""
        entry = np.zeros((self.rows, len(books)), np.int64)
        least = np.zeros((self.rows, len(books)), np.int64)
        for p, book in enumerate(books):
            tables = [(self.words[d][:, None] - book[:, d - at[p]][None, :]) ** 2 for d in range(at[p], at[p + 1])]
            for lo in range(0, self.rows, step):
                far = np.zeros((min(step, self.rows - lo), len(book)), np.int64)
                for d, tab in zip(range(at[p], at[p + 1]), tables, strict=True):
                    far += tab[self.codes[d, lo : lo + step]]
                entry[lo : lo + step, p] = far.argmin(1)
                least[lo : lo + step, p] = far.min(1)
        return entry, least

    def sums(self, books: list[np.ndarray], at: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(part, entries used, their counts, sums of components) of each part."""
        entry, _ = self.nearest(books, at)
        for p, book in enumerate(books):
            n = np.bincount(entry[:, p], minlength=len(book))
            used = np.flatnonzero(n)
            total = np.zeros((len(book), at[p + 1] - at[p]), np.int64)
            for d in range(at[p], at[p + 1]):  # a block's sums stay below 2**53
                total[:, d - at[p]] = np.bincount(entry[:, p], self.words[d][self.codes[d]], len(book))
            yield p, used, n[used], total[used]


def sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def _numbers(ints) -> np.ndarray:
    return np.stack([x.values.to_numpy() for x in ints]) if len(ints) else np.empty((0, 0), np.int64)


def encode(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
           scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
           block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, list[np.ndarray]]:
    """(per kept row: id, label, code, error), and the codebook of each part.

    Kept are rows whose vector is not null and holds no null or non-finite component. The first codebook entries
    are the parts of the `entries` rows first by id (nulls last), equal ids by their integers; fewer rows give
    fewer entries. Repeated rows count each. An empty vector has error 0 and entry 0 everywhere; parts differ by one component
    at most where `parts` doesn't divide the length. All kept vectors must have one length, and integers within
    2**26: ValueError otherwise. Other columns are left out.
    """
    if not (0 < block_rows <= 1 << 16 and 0 < entries <= 256):
        raise ValueError("blocks of 65536 rows and codes of one byte at most")
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v")).where(F.coalesce(sound, F.lit(False)))
    floors = F.transform("v", lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(2.0**40)), F.lit(-(2.0**40)))))
    rows = stage(rows.select("id", "label", floors.alias("v")))
    seen = rows.agg(F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("dim"), F.max(F.array_max(F.transform("v", F.abs))).alias("top")).first()
    if seen.dim is None:
        return spark.createDataFrame([], rows.select("id", "label").schema.add("code", "string").add("error", "long")), []
    if seen.low != seen.dim:
        raise ValueError("vectors of different lengths")
    if (seen.top or 0) > _WIDEST or seen.dim * (2 * (seen.top or 0)) ** 2 >= 2**63:
        raise ValueError("components too large for exact sums")
    at = edges(seen.dim, parts)
    first = _numbers(pa.array([r.v for r in rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()], pa.list_(pa.int64())))
    books = [first[:, at[p] : at[p + 1]].astype(np.int64) for p in range(parts)]

    def block(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            while b.num_rows:
                take = min(b.num_rows, block_rows - sum(x.num_rows for x in held))
                held.append(b.slice(0, take))
                b = b.slice(take)
                if sum(x.num_rows for x in held) == block_rows:
                    yield packed(held)
                    held = []
        if held:
            yield packed(held)

    def packed(held):
        ints = np.concatenate([_numbers(b.column(0)) for b in held])
        own = [pa.chunked_array([b.column(k) for b in held]).combine_chunks() for k in (1, 2)]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in own]
        return pa.RecordBatch.from_arrays([*lists, pa.array([Block(ints).pack()], pa.binary())], names=["ids", "labels", "payload"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    blocks = stage(rows.select("v", "id", "label").mapInArrow(block, f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, payload binary"))
    width = max(at[p + 1] - at[p] for p in range(parts))

    def gather(sent):
        def run(batches):
            total = {p: [np.zeros(len(b), np.int64), np.zeros(b.shape, np.int64)] for p, b in enumerate(sent.value)}
            for b in batches:
                for raw in b.column(0):
                    for p, used, n, s in Block.unpack(raw.as_py()).sums(sent.value, at):
                        total[p][0][used] += n
                        total[p][1][used] += s
            for p, (n, s) in total.items():
                used = np.flatnonzero(n)
                cols = [np.full(len(used), p), used, n[used], *s[used].T, *np.zeros((width - s.shape[1], len(used)), np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["part", "entry", "n", *(f"s{k}" for k in range(width))])
        return run

    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(books)  # the codebook: `entries` vectors
        names = ["n", *(f"s{k}" for k in range(width))]
        sums = blocks.select("payload").mapInArrow(gather(sent), ", ".join(f"{c} long" for c in ["part", "entry", *names]))
        new = [b.copy() for b in books]
        for r in sums.groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in names)).collect():  # a row for each entry at most
            w = at[r.part + 1] - at[r.part]
            new[r.part][r.entry] = [s // r.n for s in r[3 : 3 + w]]
        books = new
    sent = spark.sparkContext.broadcast(books)

    def code(batches):
        for b in batches:
            for i in range(b.num_rows):
                entry, far = Block.unpack(b.column("payload")[i].as_py()).nearest(sent.value, at)
                digits = [x.tobytes().hex() for x in entry.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("ids")[i].values, b.column("labels")[i].values, pa.array(digits, pa.string()), pa.array(far.sum(1))],
                    names=["id", "label", "code", "error"])

    coded = blocks.mapInArrow(code, f"id {kinds['id']}, label {kinds['label']}, code string, error long")
    return coded, books


def label_errors(coded: DataFrame, hot: int = 1024) -> DataFrame:
    """`coded` with label_error, the error summed over equal labels (nulls are equal).

    Labels that hold over one in `hot` rows, so fewer than `hot`, are broadcast; the rest join by label.
    """
    coded = stage(coded)
    per = stage(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    large = F.col("n") * hot > (per.agg(F.sum("n")).first()[0] or 0)
    known = coded.join(F.broadcast(per.where(large)), F.col("label").eqNullSafe(F.col("of")), "left")
    rest = coded.join(F.broadcast(per.where(large).select("of")), F.col("label").eqNullSafe(F.col("of")), "left_anti")
    rest = rest.join(per.where(~large), F.col("label").eqNullSafe(F.col("of")))
    cols = ["id", "code", "error", "label_error"]
    return known.where("n IS NOT NULL").select(cols).union(rest.select(cols))


def _sql() -> str:
    """The rounds as one statement: entries and assignments of each round are a step of it."""
    near = """a{r} AS (SELECT vec_id, label, part, x, best[2]::int AS entry, best[1] AS far FROM (
        SELECT vec_id, label, x.part, x.x, min([list_sum(list_transform(range(1, len(x.x) + 1), lambda i: (x.x[i] - b.x[i]) * (x.x[i] - b.x[i])))::BIGINT, b.entry]) AS best
        FROM parts x JOIN b{r} b ON x.part = b.part GROUP BY ALL))"""
    new = """b{n} AS (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN (
        SELECT part, entry, list(c ORDER BY i) AS x FROM (
            SELECT part, entry, i, (sum(x[i]) - ((sum(x[i]) % count(*)) + count(*)) % count(*)) // count(*) AS c
            FROM a{r}, (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM parts))) AS i) WHERE i <= len(x) GROUP BY ALL)
        GROUP BY ALL) m ON m.part = b.part AND m.entry = b.entry)"""
    steps = ["""kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v, row_number() OVER (ORDER BY vec_id) - 1 AS r
        FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             """parts AS (SELECT vec_id, label, r, p AS part, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS x FROM kept, (SELECT unnest(range(4)) AS p))""",
             "b0 AS (SELECT part, r AS entry, x FROM parts WHERE r < 256)"]
    for r in range(ROUNDS):
        steps += [near.format(r=r), new.format(r=r, n=r + 1)]
    steps.append(near.format(r=ROUNDS))
    return f"""WITH {', '.join(s.replace('AS (', 'AS MATERIALIZED (', 1) for s in steps)},
        coded AS (SELECT vec_id, any_value(label) AS label, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id)
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
            (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM b{ROUNDS}) AS codebooks_sha256 FROM coded"""


@query("op13_vector_codes", _sql())
def op13(spark, sf_dir):
    """vec_id, code, error, label_error, codebooks_sha256 of every kept vector."""
    coded, books = encode(table(spark, sf_dir, "embeddings"))
    return label_errors(coded).select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(sha256(books)).alias("codebooks_sha256"))
