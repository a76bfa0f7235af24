"""SentencePiece encoding and decoding with a weighted finite-state transducer.

The model file is compiled into three machines: the normaliser (its table of
replacements, longest first; dummy prefix, white space as U+2581, extra white
space), the lexicon of pieces as a trie, and byte fallback for letters the
lexicon lacks. A text composed with them is a lattice whose arcs are pieces; its
tropical shortest path is the encoding. User-defined pieces are cut out first.

- For a unigram model an arc weighs minus the piece's score.
- For a byte-pair model a merge order, not a score sum, decides. A sequence of
  pieces is the model's output exactly if every two neighbours are: merging
  their joined letters gives the two back. So an arc after piece p costs 0 if
  (p, q) is such a pair and infinity if not; states are (place, last piece),
  and one state of finite weight exists at each place. Pairs are compiled into
  the machine when first met.

No piece holds U+2581 after another letter, so paths of the parts that begin
with it are independent, and so are paths on both sides of any two letters that
stand together in no piece: each distinct part is composed once and remembered.

Encoding and decoding are maps over whole texts: no shuffle, memory by text and
by the bounded memory of parts (`MEMO`).

Defined cases: null and empty texts have no ids and decode to an empty text; a
text of unknown letters becomes byte pieces; repeated rows are treated alike;
an empty table gives an empty table. Result columns replace columns of the same
name, others stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FORGET, Memo, new_stage, slices

SPACE = "▁"
#: Distinct parts that a worker remembers in a generation of its memory, and pairs of pieces until it starts anew.
MEMO = 250_000
PAIRS = 1 << 19
#: A part of more letters is worked on but not remembered.
LONG = 64
MARKS = ".,;:!?%#$&*|"
PARTS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

class Normaliser:
    """The transducer of a model's normaliser: text to the letters that pieces are made of."""

    def __init__(self, spec, symbols: list[str]) -> None:
        self.prefix = SPACE if spec.add_dummy_prefix else ""
        self.trim, self.escape = spec.remove_extra_whitespaces, SPACE if spec.escape_whitespaces else " "
        blob = spec.precompiled_charsmap
        size = int.from_bytes(blob[:4], "little") if blob else 0
        #: A double array over UTF-8 bytes, its leaves being places of replacements.
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist() if blob else []
        self.replacements = blob[4 + size :]
        self.symbols = re.compile("|".join(map(re.escape, sorted(symbols, key=len, reverse=True)))) if symbols else None
        self.table: dict[int, str] = {}  # letters that are replaced whatever follows
        self.known: dict[str, bool] = {}  # whether more letters may belong to a replacement
        self.identity = not (self.units or self.trim or symbols or self.escape != SPACE)

    def _step(self, place: int, data: bytes) -> tuple[int, int, int]:
        """(place after the bytes or -1, end of the longest replaced run or 0, its replacement)."""
        best, value = 0, -1
        for i, byte in enumerate(data):
            place ^= byte
            unit = self.units[place]
            if unit & 0x800000FF != byte:
                return -1, best, value
            place ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                best, value = i + 1, self.units[place] & 0x7FFFFFFF
        return place, best, value

    @property
    def _root(self) -> int:
        unit = self.units[0]
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def _replacement(self, value: int) -> str:
        return self.replacements[value : self.replacements.index(b"\0", value)].decode()

    def _learn(self, letter: str) -> bool:
        data = letter.encode("utf-8", "replace")
        place, best, value = self._step(self._root, data)
        more = place >= 0 and any(self.units[place ^ b] & 0x800000FF == b for b in range(1, 256) if place ^ b < len(self.units))
        if best == len(data):
            self.table[ord(letter)] = self._replacement(value)
        self.known[letter] = more
        return more

    def replaced(self, text: str) -> str:
        """The text after the table of replacements, longest runs first from the left."""
        if not self.units:
            return text
        known = self.known
        new = set(text).difference(known)
        if not any([known.get(c) or (c in new and self._learn(c)) for c in set(text)]):
            return text.translate(self.table)
        out, at = [], 0
        while at < len(text):
            if not known[text[at]]:
                out.append(text[at].translate(self.table))
                at += 1
                continue
            # runs are short: a replaced run has few letters
            data = text[at : at + 32].encode("utf-8", "replace")
            _, best, value = self._step(self._root, data)
            if best:
                out.append(self._replacement(value))
                at += len(data[:best].decode())
            else:
                out.append(text[at])
                at += 1
        return "".join(out)

    def __call__(self, text: str) -> list[str]:
        """The letters of a text, user-defined symbols at odd places."""
        pieces: list[str] = []
        at = 0
        for m in self.symbols.finditer(text) if self.symbols else ():
            pieces += [self.replaced(text[at : m.start()]), m[0]]
            at = m.end()
        pieces.append(self.replaced(text[at:]))
        if self.trim:
            before = True  # white space at the start, or after other white space, goes
            for k, piece in enumerate(pieces):
                piece = re.sub(" +", " ", piece) if k % 2 == 0 else piece
                pieces[k] = piece[1:] if before and piece.startswith(" ") and k % 2 == 0 else piece
                before = pieces[k].endswith(" ") if pieces[k] else before
            for k in range(len(pieces) - 1, -1, -1):
                pieces[k] = pieces[k].rstrip(" ")
                if pieces[k]:
                    break
        pieces = [p if k % 2 else p.replace(" ", self.escape) for k, p in enumerate(pieces)]
        if any(pieces):
            pieces[0] = self.prefix + pieces[0]
        return pieces


_MACHINES: dict[str, Transducer] = {}
FORGET.append(_MACHINES.clear)


class Transducer:
    """The compiled machines of one model file."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = proto.ModelProto.SentencePiece
        spec, trainer = model.normalizer_spec, model.trainer_spec
        if trainer.treat_whitespace_as_suffix:
            raise ValueError("models with white space as a suffix are not supported")
        self.prefix, self.trim = SPACE if spec.add_dummy_prefix else "", spec.remove_extra_whitespaces
        self.bpe = trainer.model_type == proto.TrainerSpec.BPE
        self.pieces = [p.piece for p in model.pieces]
        self.unknown = trainer.unk_id
        self.lexicon: dict[str, int] = {}
        self.scores = [p.score for p in model.pieces]
        bytes_ids: dict[int, int] = {}
        self.symbols: dict[str, bytes] = {}
        self.surface: list[bytes] = []
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                value = int(p.piece[3:5], 16)
                bytes_ids[value] = i
                self.surface.append(bytes([value]))
            elif p.type == kinds.NORMAL:
                self.lexicon[p.piece] = i
                self.surface.append(p.piece.replace(SPACE, " ").encode())
            elif p.type == kinds.USER_DEFINED:
                self.symbols[p.piece] = np.array([i], "<i4").tobytes()
                self.surface.append(p.piece.replace(SPACE, " ").encode())
            elif p.type in (kinds.CONTROL, kinds.UNKNOWN):
                self.surface.append(trainer.unk_surface.encode() if p.type == kinds.UNKNOWN else b"")
            else:
                raise ValueError(f"pieces of type {p.type} are not supported")
        if any(SPACE in p.lstrip(SPACE) for p in self.lexicon):
            raise ValueError("models with pieces across white space are not supported")
        self.normalise = Normaliser(spec, list(self.symbols))
        self.byte_ids = [bytes_ids[b] for b in range(256)] if len(bytes_ids) == 256 else None
        self.trie: dict = {}
        for piece, i in self.lexicon.items():
            node = self.trie
            for letter in piece:
                node = node.setdefault(letter, {})
            node[""] = piece
        self.pairs: dict[str, dict[str, bool]] = {"": {}}
        self.n_pairs = 0
        self.memo = Memo(MEMO)
        self.tails: dict[str, bytes] = {}
        #: Neighbouring letters inside pieces: between others no arc passes, and paths on both sides are independent.
        self.joins = {p[k : k + 2] for p in self.lexicon for k in range(len(p) - 1)}
        self.lines = not any("\n" in p for p in self.lexicon)

    def merge(self, letters: str) -> list[str]:
        """Pieces of a few letters by the model's merge order: highest score first, then leftmost."""
        parts = list(letters)
        while len(parts) > 1:
            best, at = -inf, -1
            for k in range(len(parts) - 1):
                i = self.lexicon.get(parts[k] + parts[k + 1])
                if i is not None and self.scores[i] > best:
                    best, at = self.scores[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, p: str, q: str) -> bool:
        """Whether the arc q may follow p (p empty: begin a path); compiled when first asked."""
        if self.n_pairs > PAIRS:
            self.pairs, self.n_pairs = {"": {}}, 0
        known = self.merge(p + q) == ([p, q] if p else [q])
        self.pairs.setdefault(p, {})[q] = known
        self.n_pairs += 1
        return known

    def _arcs(self, part: str, at: int) -> list[str]:
        """Pieces of all arcs of the lattice that leave a place; a letter of no piece is an arc of its own."""
        out, node = [], self.trie
        for end in range(at, len(part)):
            node = node.get(part[end])
            if node is None:
                break
            piece = node.get("")
            if piece is not None:
                out.append(piece)
        if not out or len(out[0]) > 1:
            out.append(part[at])
        return out

    def path(self, part: str) -> list[str]:
        """Pieces of the shortest path through the lattice of a part."""
        n = len(part)
        last: list[str | None] = [None] * (n + 1)  # last piece of the best state of each place
        last[0] = ""
        if self.bpe:
            # each place has one state of finite weight, that of the prefix's own encoding
            trie, pairs = self.trie, self.pairs
            for at in range(n):
                before = last[at]
                if before is None:
                    continue
                known = pairs.get(before) or {}
                node, end, single = trie, at, False
                while end < n:
                    node = node.get(part[end])
                    if node is None:
                        break
                    end += 1
                    piece = node.get("")
                    if piece is not None:
                        single |= end == at + 1
                        if last[end] is None:
                            ok = known.get(piece)
                            if ok or (ok is None and self.follows(before, piece)):
                                last[end] = piece
                if not single and last[at + 1] is None and self.follows(before, part[at]):
                    last[at + 1] = part[at]
        else:
            weights = [0.0] + [inf] * n
            worst = min(self.scores[i] for i in self.lexicon.values()) - 10.0
            for at in range(n):
                for piece in self._arcs(part, at):
                    i, end = self.lexicon.get(piece), at + len(piece)
                    cost = weights[at] - (self.scores[i] if i is not None else worst)
                    if cost < weights[end]:
                        weights[end], last[end] = cost, piece
        if last[n] is None:
            raise ValueError(f"no path through {part!r}")
        out, at = [], n
        while at:
            out.append(last[at])
            at -= len(out[-1])
        return out[::-1]

    def part(self, part: str) -> bytes:
        """Ids of a part as little-endian 32-bit integers."""
        ids: list[int] = []
        for piece in self.path(part):
            i = self.lexicon.get(piece)
            if i is not None:
                ids.append(i)
            elif self.byte_ids is None:
                if ids[-1:] != [self.unknown]:  # a run of unknown letters is one piece
                    ids.append(self.unknown)
            else:
                ids.extend(self.byte_ids[b] for b in piece.encode("utf-8", "replace"))
        return np.array(ids, "<i4").tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        plain = self.normalise.identity and SPACE not in text and "  " not in text and text[0] != " " and text[-1] != " " and self.prefix
        if plain:
            parts = (text.replace("\n", " \n") if self.lines else text).split(" ")  # with a space before it, or a line end
        if not plain or "" in parts:
            between = self.normalise(text)
            if len(between) > 1:
                return b"".join(self.symbols[p] if k % 2 else self._whole(p) for k, p in enumerate(between))
            parts = [SPACE + p for p in PARTS.findall(between[0])]  # marked as written out
        return self._ids(parts)

    def _whole(self, letters: str) -> bytes:
        """Ids of normalised letters."""
        return self._ids([SPACE + p for p in PARTS.findall(letters)])

    def _ids(self, parts: list[str]) -> bytes:
        memo = self.memo
        try:
            return b"".join(map(memo.__getitem__, parts))
        except KeyError:
            pass
        out = []
        for p in parts:
            ids = memo.get(p) or memo.recall(p)
            if ids is None:
                ids = self._new(p)
                if len(p) <= LONG:
                    memo[p] = ids
            out.append(ids)
        memo.age()
        return b"".join(out)

    def _new(self, p: str) -> bytes:
        """Ids of a part that isn't remembered; a word's punctuation is taken apart from it where no piece joins them."""
        root = p.rstrip(MARKS) if self.byte_ids is not None else ""
        if root and root != p and root[-1] != SPACE and root[-1] + p[len(root)] not in self.joins:
            head = self.memo.get(root) or self.memo.recall(root)
            if head is None:
                head = self._new(root)
                if len(root) <= LONG:
                    self.memo[root] = head
            tail = self.tails.get(p[len(root) :])
            if tail is None:
                tail = self.part(p[len(root) :])
                if len(self.tails) < 10_000:
                    self.tails[p[len(root) :]] = tail
            return head + tail
        return self.part(p[1:] if p[0] == SPACE else p if p[0] == "\n" and self.lines else SPACE + p)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no text become U+FFFD."""
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if (self.prefix or self.trim) and text.startswith(" ") else text


def machine(path: str) -> Transducer:
    """The worker's machines of a model file."""
    new_stage()
    if path not in _MACHINES:
        _MACHINES[path] = Transducer(path)
    return _MACHINES[path]


def _batch_lists(raw: list[bytes]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(r) // 4 for r in raw]))).astype(np.int64)
    values = np.frombuffer(b"".join(raw), "<i4")
    return pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(values)).cast(pa.list_(pa.int32()))


def _encode(path: str, place: int, names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = machine(path)
    for batch in slices(batches, place):
        raw = [codec.encode(t or "") for t in batch.column(place).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in names), _batch_lists(raw), pa.array([len(r) // 4 for r in raw], pa.int64())], names=[*names, "ids", "n_ids"]
        )


def _decode(path: str, place: int, names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = machine(path)
    for batch in slices(batches, place):
        texts = [codec.decode(ids or []) for ids in batch.column(place).to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string())], names=[*names, "decoded"])


def _both(path: str, place: int, names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = machine(path)
    for batch in slices(batches, place):
        raw = [codec.encode(t or "") for t in batch.column(place).to_pylist()]
        texts = [codec.decode(np.frombuffer(r, "<i4").tolist()) for r in raw]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in names), _batch_lists(raw), pa.array([len(r) // 4 for r in raw], pa.int64()), pa.array(texts, pa.string())],
            names=[*names, "ids", "n_ids", "decoded"],
        )


def _map(df: DataFrame, column: str, job, made: str, results: tuple[str, ...], keep: list[str] | None) -> DataFrame:
    names = [c for c in keep or df.columns if c not in results]
    read = df.select(*(F.col(c).alias(f"c{k}") for k, c in enumerate(names)), F.col(column).alias("_in"))
    inner = [f"c{k}" for k in range(len(names))]
    fields = [f"{n} {read.schema[n].dataType.simpleString()}" for n in inner]
    out = read.mapInArrow(partial(job, len(names), inner), ", ".join([*fields, made]))
    return out.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(names)), *results)


def encode(docs: DataFrame, model: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with ids and n_ids."""
    return _map(docs, text, partial(_encode, model), "ids array<int>, n_ids bigint", ("ids", "n_ids"), keep)


def decode(tokens: DataFrame, model: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """tokens (or its columns `keep`) with the decoded text."""
    return _map(tokens, ids, partial(_decode, model), "decoded string", ("decoded",), keep)


def encode_decode(docs: DataFrame, model: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """encode and decode in one pass over the texts: docs (or its columns `keep`) with ids, n_ids and decoded."""
    return _map(docs, text, partial(_both, model), "ids array<int>, n_ids bigint, decoded string", ("ids", "n_ids", "decoded"), keep)
