"""Token ids in files of directly addressable codes: any token is read without decoding a block.

An id is split into chunks from its lowest bits up. Level k of a file holds the k-th chunk of every id that has
one, packed at the width of the level, and a bitmap that says which of these ids continue in level k + 1; the
rank of a set bit is the place there. A rank directory (the number of set bits before every RANK_BITS bits) makes
a rank one small read, so a token costs a few bytes a level. The widths of a file minimise its size, found by a
small dynamic programme over how many ids have how many bits.

File, little-endian: MAGIC, HEAD (levels, documents, documents with a null id, ids, crc32 of what follows), for
each level LEVEL (width, chunks, places of chunks, bitmap and directory), the documents' ids (int64; null ids come first and
hold 0), their starts and the end of the last (uint64), then for each level chunks, bitmap and directory.

Documents are dealt by ranges of (doc_id, hash of the text) and each task writes its range in order as files of about
SHARD_IDS ids; a document is never cut, so a longer one is a longer file. Files have names of their own for every
attempt, and the manifest, a table that Spark commits, names those of the attempts that succeeded: a lost executor
leaves unnamed files, never wrong or missing ones.

Cases: a null or empty text is the end id alone; rows with null ids come first; repeated rows are written as often as they
occur, rows of one id in the order of their texts' hashes (equal hashes: equal texts, any order); an empty table gives no file and no rows; very long
texts are encoded whole, one at a time; other columns are ignored and can't clash, as only doc_id and text are read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, documents, small_batches
from .packing import encoder, tokenizer_files

END_ID = 0
SHARD_IDS = 1 << 20
RANK_BITS = 512
MAGIC = b"DACIDS01"
HEAD, LEVEL = struct.Struct("<IIQQQ"), struct.Struct("<IQQQQ")
_STEP = 1 << 18


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """values at `width` bits each, the lowest bit first."""
    if width in (8, 16, 32):
        return values.astype(f"<u{width // 8}").tobytes()
    out = []
    for at in range(0, len(values), _STEP):
        part = np.unpackbits(values[at : at + _STEP].astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, count=width, bitorder="little")
        out.append(np.packbits(part, bitorder="little").tobytes())
    return b"".join(out)


def unpack_bits(data: bytes, width: int, n: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype(np.uint32)
    raw, out = np.frombuffer(data, np.uint8), np.zeros(n, np.uint32)
    for at in range(0, n, _STEP):
        m = min(_STEP, n - at)
        bits = np.unpackbits(raw[at * width // 8 : -(-(at + m) * width // 8)], count=m * width, bitorder="little").reshape(m, width)
        wide = np.zeros((m, 32), np.uint8)
        wide[:, :width] = bits
        out[at : at + m] = np.packbits(wide, axis=1, bitorder="little").view("<u4")[:, 0]
    return out


def widths_for(ids: np.ndarray) -> list[int]:
    """The widths of the levels that make the file smallest."""
    have = np.bincount(np.maximum(np.frexp(ids.astype(np.float64))[1], 1), minlength=2)
    most = len(have) - 1
    longer = [int(have[s + 1 :].sum()) for s in range(most + 1)]  # ids with more than s bits
    best: list[tuple[float, list[int]]] = [(0.0, [])] * (most + 1)
    for s in range(most - 1, -1, -1):
        n = longer[s] if s else int(have.sum())
        best[s] = min((n * (w + (s + w < most) * (1 + 64 / RANK_BITS)) + best[s + w][0], [w, *best[s + w][1]]) for w in range(1, most - s + 1))
    return best[0][1]


def encode_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """One file. doc_ids with nulls first; ids of all documents, one after the other."""
    nulls = sum(i is None for i in doc_ids)
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
    widths = widths_for(ids)
    place = len(MAGIC) + HEAD.size + LEVEL.size * len(widths)
    body = [np.array([i or 0 for i in doc_ids], "<i8").tobytes(), starts.tobytes()]
    place += len(body[0]) + len(body[1])
    heads, rest = [], ids
    for k, w in enumerate(widths):
        parts, places = [pack_bits(rest & np.uint32((1 << w) - 1), w)], []
        n, rest = len(rest), rest >> np.uint32(w) if w < 32 else np.zeros(len(rest), np.uint32)
        if k + 1 < len(widths):
            on = rest > 0
            parts.append(np.packbits(on, bitorder="little").tobytes())
            before = np.concatenate([[0], np.cumsum(np.add.reduceat(on, np.arange(0, n, RANK_BITS), dtype=np.int64))])
            parts.append(before.astype("<u8").tobytes())
            rest = rest[on]
        for x in parts + [b""] * (3 - len(parts)):
            places.append(place)
            body.append(x)
            place += len(x)
        heads.append(LEVEL.pack(w, n, *places))
    data = b"".join(heads + body)
    return MAGIC + HEAD.pack(len(widths), zlib.crc32(data), len(doc_ids), nulls, len(ids)) + data


class TokenFile:
    """A file, read through read_at(n_bytes, place); only the header is held."""

    def __init__(self, read_at: Callable[[int, int], bytes]):
        self.read_at = read_at
        first = read_at(len(MAGIC) + HEAD.size, 0)
        if first[: len(MAGIC)] != MAGIC:
            raise ValueError("not a file of token ids")
        n, self.crc32, self.n_docs, self.n_null, self.n_ids = HEAD.unpack(first[len(MAGIC) :])
        heads = read_at(LEVEL.size * n, len(first))
        self.levels = [LEVEL.unpack_from(heads, LEVEL.size * k) for k in range(n)]
        self.docs_at = len(first) + LEVEL.size * n

    def verify(self, size: int) -> None:
        """An error if what follows the head is not what was written."""
        at = len(MAGIC) + HEAD.size
        if zlib.crc32(self.read_at(size - at, at)) != self.crc32:
            raise ValueError("a file of token ids is damaged")

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """Ids of the documents; their starts and the end of the last."""
        ids = np.frombuffer(self.read_at(8 * self.n_docs, self.docs_at), "<i8").tolist()
        starts = np.frombuffer(self.read_at(8 * (self.n_docs + 1), self.docs_at + 8 * self.n_docs), "<u8").astype(np.int64)
        return [None] * self.n_null + ids[self.n_null :], starts

    def token(self, at: int) -> int:
        """The id at one place: a chunk, a bit and a rank of each level that it reaches."""
        if not 0 <= at < self.n_ids:
            raise IndexError(at)
        value = shift = 0
        for k, (width, _, chunks, bitmap, directory) in enumerate(self.levels):
            low, high = at * width // 8, -(-(at + 1) * width // 8)
            value |= (int.from_bytes(self.read_at(high - low, chunks + low), "little") >> (at * width % 8) & ((1 << width) - 1)) << shift
            if k + 1 == len(self.levels):
                break
            block = at // RANK_BITS
            bits = int.from_bytes(self.read_at(at // 8 - block * RANK_BITS // 8 + 1, bitmap + block * RANK_BITS // 8), "little")
            inside = at - block * RANK_BITS
            if not bits >> inside & 1:
                break
            at = int.from_bytes(self.read_at(8, directory + 8 * block), "little") + (bits & ((1 << inside) - 1)).bit_count()
            shift += width
        return value

    def ids(self) -> np.ndarray:
        """All ids, level by level."""
        out, reached, shift = np.zeros(self.n_ids, "<u4"), None, 0
        for k, (width, n, chunks, bitmap, _) in enumerate(self.levels):
            part = unpack_bits(self.read_at(-(-n * width // 8), chunks), width, n) << np.uint32(shift)
            if reached is None:
                out[:] = part
            else:
                out[reached] |= part
            if k + 1 < len(self.levels):
                on = np.flatnonzero(np.unpackbits(np.frombuffer(self.read_at(-(-n // 8), bitmap), np.uint8), count=n, bitorder="little"))
                reached, shift = on if reached is None else reached[on], shift + width
        return out


def folder(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a URI (file, hdfs, viewfs, s3, gs, abfs) and the path in it."""
    return pa.fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


MANIFEST = "file string, part int, seq int, n_docs long, n_ids long, n_bytes long"


def write(docs: DataFrame, root: str, scratch: Scratch, tokenizer: str | None = None, end_id: int = END_ID, shard_ids: int = SHARD_IDS, parts: int | None = None) -> DataFrame:
    """Writes all documents to files in the folder `root` (a URI that all executors reach) in ascending order of doc_id.

    Returns the manifest: a row for each file, with the number of ids in the files before it (start).
    """
    spark = docs.sparkSession
    files = tokenizer_files(tokenizer)
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(*files).ids, TaskContext.get().partitionId()
        system, base = folder(root)
        system.create_dir(base, recursive=True)
        names, lengths, arrays, held, seq = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal names, lengths, arrays, held, seq
            data = encode_file(names, lengths, np.concatenate(arrays))
            name = f"ids-{part:06d}-{seq:06d}-{uuid.uuid4().hex}.dac"
            with system.open_output_stream(f"{base}/{name}") as out:
                out.write(data)
            row = {"file": [name], "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_docs": [len(names)], "n_ids": [held], "n_bytes": [len(data)]}
            names, lengths, arrays, held, seq = [], [], [], 0, seq + 1
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for k in range(batch.num_rows):
                ids = np.append(encode(batch.column(1)[k].as_py() or ""), np.uint32(end_id)).astype("<u4", copy=False)
                if held and held + len(ids) > shard_ids:
                    yield flush()
                names.append(batch.column(0)[k].as_py())
                lengths.append(len(ids))
                arrays.append(ids)
                held += len(ids)
        if held:
            yield flush()

    keys = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    with small_batches(spark, 256):
        written = scratch.save(ordered.mapInArrow(store, MANIFEST), "manifest")
    total = written.groupBy("part").agg(F.sum("n_ids").alias("__n"))
    # One row for each part, a number that is chosen here: small enough for one task and for a broadcast.
    before = total.select("part", F.coalesce(F.sum("__n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__from"))
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return written.join(F.broadcast(before), "part").select(*written.columns, (F.col("__from") + inside).alias("start"))


DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read(manifest: DataFrame, root: str, keep_ids: bool = False) -> DataFrame:
    """The documents in the files of the manifest; keep_ids adds the ids themselves."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = folder(root)
        for batch in batches:
            for name, size, start in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                with system.open_input_file(f"{base}/{name}") as source:
                    one = TokenFile(source.read_at)
                    one.verify(size)
                    doc_ids, starts = one.documents()
                    ids = one.ids()
                spans = list(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True))
                rows = {"doc_id": pa.array(doc_ids, pa.int64()), "start": starts[:-1] + start, "n_tokens": np.diff(starts), "ids_crc32": [zlib.crc32(ids[a:b].tobytes()) for a, b in spans]}
                if keep_ids:
                    rows["ids"] = pa.array([ids[a:b].astype(np.int64) for a, b in spans], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(rows)

    # Manifest rows are few and small, files are neither: a number of parts that adaptive execution doesn't merge.
    spark = manifest.sparkSession
    dealt = manifest.select("file", "n_bytes", "start").repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "file")
    return dealt.mapInArrow(load, DOCUMENTS + (", ids array<long>" if keep_ids else ""))


def tokens_at(manifest: DataFrame, root: str, places: DataFrame, at: str = "at", shard_ids: int = SHARD_IDS) -> DataFrame:
    """(at, token) for the places (numbers of ids from the first of all documents on): each read by itself, no file decoded.

    Files and places meet on blocks of shard_ids ids. Places outside, and nulls, have no row; repeated places have one each.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = folder(root)
        name = source = one = None
        for batch in batches:
            found = []
            for file, inside in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if file != name:
                    if source:
                        source.close()
                    source, name = system.open_input_file(f"{base}/{file}"), file
                    one = TokenFile(source.read_at)
                found.append(one.token(inside))
            yield pa.RecordBatch.from_pydict({at: batch.column(0), "token": pa.array(found, pa.int64())})
        if source:
            source.close()

    last = F.col("start") + F.col("n_ids") - 1
    blocks = manifest.select("file", "start", last.alias("__last"), F.explode(F.sequence(F.expr(f"start div {shard_ids}"), F.floor(last / shard_ids))).alias("__block"))
    wanted = places.select(F.col(at).cast("long").alias(at)).withColumn("__block", F.expr(f"`{at}` div {shard_ids}"))
    met = wanted.join(blocks, "__block").filter(F.col(at).between(F.col("start"), F.col("__last")))
    return met.select(at, "file", (F.col(at) - F.col("start")).alias("__inside")).sortWithinPartitions("file", "__inside").mapInArrow(look, f"`{at}` long, token long")


def op11_token_files(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "token-files")
    root = scratch.path("files")
    return read(write(documents(spark, sf_dir), root, scratch), root)
