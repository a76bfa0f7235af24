"""Token-ID output: Arrow files of equal-length sequences with masks.

A data set is a folder of shards. Shard k holds the documents of one range of
doc_id in ascending order, tokenised, each closed by an end id, packed one
after the other into sequences of `length` ids:

- `ids-<k>-<attempt>.arrow`: Arrow file (random access by record batch) with
  columns `ids` fixed_size_list<uint16 or uint32>[length] and `mask`
  fixed_size_list<uint8>[length / 8], one bit an id, lowest bit first. Every
  batch has `BATCH_ROWS` sequences but the last, so sequence n of a shard is row
  n % BATCH_ROWS of batch n // BATCH_ROWS, and its ids and mask are read without
  a copy. Only the last sequence of a shard is padded; its mask is 0 there.
- `docs-<k>-<attempt>.arrow`: doc_id, place of its first id in the shard, number of ids.

Ranges come from Spark's range partitioner over doc_id, a hash of the text and
the row's place, so a shard is one task's share and no repeated or missing doc_id
makes one longer. The manifest (one row a shard, with the attempt that wrote
it) is a table in the shared folder: files of lost or repeated attempts are in
no manifest and are never read. The place of a shard in the whole stream is a
running sum over the manifest, one row a shard.

Defined cases: null text is empty and becomes the end id alone; documents
without a doc_id come first; rows that repeat a doc_id are all written, ordered
by a hash of the text; a very long text is tokenised whole and runs on over
sequences; an empty table gives a data set without sequences; other columns are
not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import FORGET, Memo, new_stage, slices, written

LENGTH = 2048
BATCH_ROWS = 64
#: Distinct chunks whose ids a worker keeps in a generation of its memory.
MEMO = 1_000_000
#: Bytes of text that are encoded at once: the more, the fewer chunks are looked up again.
ENCODE_BYTES = 8 << 20
MANIFEST = "shard int, attempt bigint, n_docs bigint, n_ids bigint, n_rows bigint"

_TOKENIZERS: dict[str, ChunkEncoder] = {}
FORGET.append(_TOKENIZERS.clear)


class ChunkEncoder:
    """Ids of whole texts by the tokenizers library, as bytes of little-endian integers of `kind`.

    A byte-level pre-tokenizer starts a new token at a space or a line end
    between printing characters, so a text is cut there, each distinct chunk
    is encoded once and the ids are joined. Texts in which white space meets
    other white space or a control character are encoded as a whole, as are
    texts that hold the string of an added token, which the library cuts first.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        vocab = self.tokenizer.get_vocab()
        # each character of a byte-level token stands for one byte
        self.sizes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.sizes[i] = len(token)
        self.kind = np.dtype("<u2" if len(self.sizes) <= 1 << 16 else "<u4")
        self.chunks, self.heads = Memo(MEMO), Memo(MEMO // 10)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[str]) -> None:
        """Encodes distinct chunks in a few long texts and cuts the ids at the chunks' bytes."""
        for at in range(0, len(chunks), 512):
            some = chunks[at : at + 512]
            begun = [c if c[0] == "\n" else " " + c for c in some]
            text = "".join(begun)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
            sizes = list(map(len, begun)) if text.isascii() else [len(c.encode()) for c in begun]
            cuts = ((np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(sizes)) + 1) * self.kind.itemsize).tolist()
            raw = ids.tobytes()
            self.chunks.update(zip(some, [raw[i:j] for i, j in zip([0, *cuts], cuts)], strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        self.chunks.age()
        self.heads.age()
        cut = [k for k, t in enumerate(texts) if any(map(t.__contains__, self.added))]
        if cut:
            own = dict(zip(cut, self._whole([texts[k] for k in cut]), strict=True))
            rest = iter(self.encode([t for k, t in enumerate(texts) if k not in own]))
            return [own[k] if k in own else next(rest) for k in range(len(texts))]
        parts = [t.replace("\n", " \n").split(" ") for t in texts]
        firsts = [p.pop(0) for p in parts]
        recall = self.chunks.recall
        fresh = [c for c in set().union(*parts).difference(self.chunks) if recall(c) is None]
        odd = {c for c in fresh if not _plain(c)}
        self._learn([c for c in fresh if c not in odd] if odd else fresh)
        new = [h for h in set(firsts).difference(self.heads) if self.heads.recall(h) is None]
        self.heads.update(zip(new, self._whole(new), strict=True))
        heads = [self.heads[h] for h in firsts]
        if odd:
            whole = [k for k, p in enumerate(parts) if not odd.isdisjoint(p)]
            for k, ids in zip(whole, self._whole([texts[k] for k in whole]), strict=True):
                heads[k] = ids
                parts[k].clear()
        get = self.chunks.__getitem__
        return [h + b"".join(map(get, p)) for h, p in zip(heads, parts, strict=True)]


def _plain(chunk: str) -> bool:
    """Whether a chunk starts with a printing character, after a line end if there is one, and holds no other white space at its rim."""
    body = chunk[1:] if chunk[:1] == "\n" else chunk
    return bool(body) and body[0].isprintable() and not body[0].isspace() and body[-1].isprintable() and not body[-1].isspace()


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder of a vocabulary file."""
    new_stage()
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ChunkEncoder(path)
    return _TOKENIZERS[path]


def _schema(dtype: pa.DataType, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(dtype, length)), ("mask", pa.list_(pa.uint8(), length // 8))])


DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class ShardWriter:
    """Packs ids into sequences and writes full batches as they come; holds one batch at most."""

    def __init__(self, store: fs.FileSystem, path: str, dtype: np.dtype, length: int) -> None:
        self.kind, self.length = dtype, length
        self.schema = _schema(pa.from_numpy_dtype(dtype), length)
        self.sink = store.open_output_stream(path)
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.held, self.n_held, self.n_ids, self.n_rows = [], 0, 0, 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        full = self.length * BATCH_ROWS
        if self.n_held >= full:
            flat = np.concatenate(self.held)
            for at in range(0, len(flat) - full + 1, full):
                self._batch(flat[at : at + full], full)
            rest = flat[len(flat) // full * full :]
            self.held, self.n_held = [rest], len(rest)

    def _batch(self, flat: np.ndarray, real: int) -> None:
        mask = np.packbits(np.arange(len(flat)) < real, bitorder="little")
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), n) for x, n in ((flat, self.length), (mask, self.length // 8))]
        self.file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.n_rows += len(flat) // self.length

    def close(self) -> None:
        if self.n_held:
            flat = np.concatenate(self.held)
            rows = -(-len(flat) // self.length)
            padded = np.zeros(rows * self.length, self.kind)
            padded[: len(flat)] = flat
            self._batch(padded, len(flat))
        self.file.close()
        self.sink.close()


def write_shard(folder: str, make: Callable[[], ChunkEncoder], end_id: int, length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Writes the sorted (doc_id, text) rows of one task as a shard; yields its manifest row."""
    context = TaskContext.get()
    shard, attempt = context.partitionId(), context.taskAttemptId()
    store, root = fs.FileSystem.from_uri(folder)
    codec, out, n_docs = make(), None, 0
    kind, docs_file = codec.kind, None
    for batch in slices(batches, 1, ENCODE_BYTES):
        if out is None:
            store.create_dir(root, recursive=True)
            out = ShardWriter(store, f"{root}/ids-{shard}-{attempt}.arrow", kind, length)
            docs_sink = store.open_output_stream(f"{root}/docs-{shard}-{attempt}.arrow")
            docs_file = pa.ipc.new_file(docs_sink, DOCS)
        starts, counts = [], []
        end, at = np.array([end_id], kind).tobytes(), out.n_ids
        encoded = codec.encode([t or "" for t in batch.column(1).to_pylist()])
        for raw in encoded:
            starts.append(at)
            counts.append(len(raw) // kind.itemsize + 1)
            at += counts[-1]
        out.add(np.frombuffer(end.join(encoded) + end, kind))
        docs_file.write_batch(pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], schema=DOCS))
        n_docs += batch.num_rows
    if out is not None:
        out.close()
        docs_file.close()
        docs_sink.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([x], t) for x, t in ((shard, pa.int32()), (attempt, pa.int64()), (n_docs, pa.int64()), (out.n_ids, pa.int64()), (out.n_rows, pa.int64()))],
            names=["shard", "attempt", "n_docs", "n_ids", "n_rows"],
        )


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, length: int = LENGTH, shards: int | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the data set into `folder` (a URI all executors reach); returns its manifest with `base`, the ids before each shard."""
    if length % 8:
        raise ValueError("length must be a multiple of 8")
    n = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "h", "place"]
    dealt = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("place"))
        .repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
    )
    manifest = written(dealt.mapInArrow(partial(write_shard, folder, partial(encoder, tokenizer), end_id, length), MANIFEST), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


class ShardReader:
    """Random access to a shard's sequences; local files are mapped, others read by batch."""

    def __init__(self, folder: str, shard: int, attempt: int) -> None:
        store, root = fs.FileSystem.from_uri(folder)
        path = f"{root}/ids-{shard}-{attempt}.arrow"
        source = pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("ids").type.list_size
        self.docs = pa.ipc.open_file(store.open_input_file(f"{root}/docs-{shard}-{attempt}.arrow"))
        self.at, self.batch = -1, None
        self.wide_at, self.wide = -1, memoryview(b"")

    def _load(self, k: int) -> pa.RecordBatch:
        if self.at != k:
            self.at, self.batch = k, self.file.get_batch(k)
        return self.batch

    def sequence(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and packed mask of sequence n, both without a copy."""
        batch, row = self._load(n // BATCH_ROWS), n % BATCH_ROWS
        return tuple(batch.column(k)[row].values.to_numpy(zero_copy_only=True) for k in (0, 1))

    def mask(self, n: int) -> np.ndarray:
        """The mask of sequence n, one boolean an id."""
        return np.unpackbits(self.sequence(n)[1], bitorder="little").view(bool)

    def stream(self, start: int, count: int) -> Iterator[memoryview]:
        """The count ids from place start of the shard as little-endian 32-bit integers, in pieces of one batch."""
        size = self.length * BATCH_ROWS
        while count > 0:
            if self.wide_at != start // size:
                self.wide_at = start // size
                self.wide = memoryview(self._load(self.wide_at).column(0).flatten().to_numpy().astype("<u4")).cast("B")
            piece = self.wide[start % size * 4 : (start % size + count) * 4]
            yield piece
            start, count = start + len(piece) // 4, count - len(piece) // 4


def read_shards(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, start, n_tokens, ids_crc32) of all documents of the shards (shard, attempt, base)."""
    for batch in batches:
        for shard, attempt, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            reader = ShardReader(folder, shard, attempt)
            for k in range(reader.docs.num_record_batches):
                rows = reader.docs.get_batch(k)
                sums = []
                for start, count in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True):
                    crc = 0
                    for piece in reader.stream(start, count):
                        crc = zlib.crc32(piece, crc)
                    sums.append(crc)
                starts = pa.array(np.asarray(rows.column(1)) + base, pa.int64())
                yield pa.RecordBatch.from_arrays([rows.column(0), starts, rows.column(2), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """One row a document, read back from the files of the data set."""
    shards = manifest.select("shard", "attempt", "base").repartition(max(1, manifest.count()), "shard")
    return shards.mapInArrow(partial(read_shards, folder), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
