"""Encoding to pieces with the place of every piece in the original text, and decoding.

A text is normalised by longest prefixes of the compiled character map, with a record of the stretches that this
changed and of their source bytes; under an empty map these are the spaces. The normalised text is cut into segments;
the different ones of a block of texts are merged together, each once. The ends of all pieces are carried back over the
record, so the spans of a text's pieces lie end to end over all its bytes. A character without a piece gives its bytes,
of which the last has the character's span.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from reelmetrics.llm.pieces import BYTE, CONTROL, SPACE, UNKNOWN, PieceModel, merges_of, tools
from reelmetrics.llm.shared import appended, tokenizer_path

MODEL = "piece_bpe_32k.model"
# Characters of a segment that is merged with others of such a length; longer ones are read off the trie, in linear time.
SHORT = (8, 16, 24)
# Bytes of a block of texts, if it has more than one; and segments that are merged together.
BLOCK, TOGETHER = 1 << 21, 1 << 14


def _gathered(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Stretches of ``values`` end to end."""
    before = np.cumsum(size) - size
    return values[np.repeat(start - before, size) + np.arange(size.sum())]


class Encoder:
    def __init__(self, data: bytes):
        self.model, self.normalizer, self.transducer = tools(data)
        self.merges = merges_of(data)
        names, kinds = self.model.names, self.model.kinds
        self.sizes = np.array([0 if k == BYTE else len(n.encode()) for n, k in zip(names, kinds)], np.int64)
        # Bytes of the character that a byte piece begins; 0 for all other pieces.
        self.leads = np.zeros(len(names), np.int8)
        byte = np.arange(256)
        self.leads[self.model.byte_ids] = np.select([byte < 0x80, byte < 0xC0, byte < 0xE0, byte < 0xF0], [1, 0, 2, 3], 4)

    def clear(self) -> None:
        """Give the tables' memory back; a worker may go on to other work."""
        self.transducer.clear()

    def segment(self, text: str) -> list[int]:
        """Ids of a long segment of normalised text."""
        ids: list[int] = []
        for piece in self.transducer.pieces(text):
            known = self.model.ids.get(piece)
            if known is not None:
                ids.append(known)
            else:
                ids.extend([self.model.byte_ids[b] for b in piece.encode()])
        return ids

    def segments(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of different segments, and where each one's ids begin and how many they are."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        start, many = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        parts, n = [], 0
        for low, high in zip((0, *SHORT), SHORT):
            all_of = np.flatnonzero((sizes > low) & (sizes <= high))
            for of in (all_of[a : a + TOGETHER] for a in range(0, len(all_of), TOGETHER)):
                ids, many[of] = self.merges.ids([texts[i] for i in of.tolist()])
                start[of] = n + np.cumsum(many[of]) - many[of]
                parts.append(ids)
                n += len(ids)
        for i in np.flatnonzero(sizes > SHORT[-1]).tolist():
            ids = np.array(self.segment(texts[i]), np.int32)
            start[i], many[i] = n, len(ids)
            parts.append(ids)
            n += len(ids)
        return np.concatenate([np.zeros(0, np.int32), *parts]), start, many

    def covered(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of normalised text that each piece covers; of a character's byte pieces the last covers all."""
        sizes, length = self.sizes[ids], self.leads[ids]
        lead = np.flatnonzero(length)
        sizes[lead + length[lead] - 1] = length[lead]
        return sizes

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text's pieces, and n + 1 places in its UTF-8 bytes: piece i spans from place i to place i + 1."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """``encode`` of each text; a segment that comes again is merged once."""
        numbers: defaultdict[str, int] = defaultdict(count().__next__)
        found, records = [], []
        for text in texts:
            norm, record = self.normalizer.recorded(text)
            words = self.transducer.words(norm)
            if words is None:  # a mark before a segment tells it from words' keys, which have none
                words = [SPACE + s for s in self.transducer.segment.findall(norm)]
            found.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
            records.append(record)
        word = self.transducer.word
        ids, start, size = self.segments([k[1:] if k[:1] == SPACE else word(k) for k in numbers])
        many = [int(size[x].sum()) for x in found]
        of = np.concatenate([np.zeros(0, np.int64), *found])
        ids = _gathered(ids, start[of], size[of]).astype("<u4")
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.covered(ids))])
        out, a = [], 0
        for n, record in zip(many, records):
            out.append((ids[a : a + n], record.places(ends[a : a + n + 1] - ends[a]).astype("<u4")))
            a += n
        return out


@lru_cache(maxsize=1)
def encoder_of(data: bytes) -> Encoder:
    """A model's encoder, kept for later tasks of a Python worker."""
    return Encoder(data)


class Decoder:
    """Pieces back to text, as the piece format's library does it."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.raw = [self._raw(name, kind) for name, kind in zip(model.names, model.kinds)]
        self.mark = SPACE.encode()
        self.bytes, self.controls = set(model.byte_ids), {i for i, k in enumerate(model.kinds) if k == CONTROL}
        self.lead_of_mark = model.byte_ids[self.mark[0]]
        self.size = np.array([len(r) for r in self.raw], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes_of_all = np.frombuffer(b"".join(self.raw), np.uint8)
        self.is_control = np.array([k == CONTROL for k in model.kinds])
        self.with_care = self.is_control.copy()
        self.with_care[self.lead_of_mark] = True

    @staticmethod
    def _raw(name: str, kind: int) -> bytes:
        if kind == CONTROL:
            return b""
        if kind == BYTE:
            return bytes([int(name[3:5], 16)])
        return " ⁇ ".encode() if kind == UNKNOWN else name.encode()

    def decode(self, ids: list[int]) -> str:
        """The text of ids. Bytes that are no UTF-8 become U+FFFD each; the mark before the first word goes."""
        present = set(ids)
        controls = present & self.controls
        inner = controls and sum(map(ids.count, controls)) > (ids[0] in controls) + (ids[-1] in controls and len(ids) > 1)
        # Byte pieces next to one another are one run, which a control ends; a mark made of bytes stays.
        if inner and not present.isdisjoint(self.bytes) or self.lead_of_mark in present:
            return self._slowly(ids)
        return self._plainly(b"".join([self.raw[i] for i in ids]))

    def decode_all(self, texts: list[np.ndarray]) -> list[str]:
        """``decode`` of the ids of each text."""
        ids = np.concatenate([np.zeros(0, np.int64), *texts]).astype(np.int64)
        sizes = self.size[ids]
        whole = b"".join([_gathered(self.bytes_of_all, self.start[ids[a : a + BLOCK]], sizes[a : a + BLOCK]).tobytes() for a in range(0, len(ids), BLOCK)])
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)])[bounds].tolist()
        # Controls inside a text, and bytes that may spell the mark.
        care = self.with_care[ids]
        edges = np.concatenate([bounds[:-1], bounds[1:] - 1])
        edges = edges[(edges >= 0) & (edges < len(ids))]
        care[edges] &= ~self.is_control[ids[edges]]
        slow = set((np.searchsorted(bounds, np.flatnonzero(care), "right") - 1).tolist())
        return [self.decode(x.tolist()) if i in slow else self._plainly(whole[ends[i] : ends[i + 1]]) for i, x in enumerate(texts)]

    def _plainly(self, whole: bytes) -> str:
        if (self.model.dummy_prefix or self.model.trim_spaces) and whole.startswith(self.mark):
            whole = whole[len(self.mark) :]
        return _utf8(whole).replace(SPACE, " ")

    def _slowly(self, ids: list[int]) -> str:
        out, run, start = [], bytearray(), True
        for i in ids:
            kind = self.model.kinds[i]
            if kind == CONTROL:
                out.append(_utf8(bytes(run)))
                run.clear()
                continue
            if kind == BYTE:
                run += self.raw[i]
                start = False
                continue
            out.append(_utf8(bytes(run)))
            run.clear()
            piece = self.raw[i].decode()
            if start and kind != UNKNOWN and (self.model.dummy_prefix or self.model.trim_spaces):
                piece = piece.removeprefix(SPACE)
            start = False
            out.append(piece.replace(SPACE, " "))
        return "".join(out) + _utf8(bytes(run))


INVALID = re.compile("[\udc80-\udcff]")


def _utf8(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return INVALID.sub("�", raw.decode(errors="surrogateescape"))


def _model_bytes(model: str) -> bytes:
    with open(tokenizer_path(model), "rb") as file:
        return file.read()


def _blocks(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in order, with texts of about ``BLOCK`` bytes together."""
    before = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)) // BLOCK
    cuts = [0, *(np.flatnonzero(np.diff(before)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            yield batch.slice(a, b - a)


def encode(docs: DataFrame, model: str = MODEL, marks: bool = True, decoded: bool = False) -> DataFrame:
    """The rows with ``ids`` and ``places``, little-endian unsigned 32-bit numbers; columns of these names go.

    ``ids`` has begin and end ids around if ``marks``. ``places`` has one number more than pieces: piece i spans the
    bytes from place i to place i + 1 of the text. A null text is an empty one: no pieces, the one place 0. With
    ``decoded`` the text of the ids is added, as ``decode`` gives it, without another pass through Python.
    """
    data = _model_bytes(model)
    added = {"ids": BinaryType(), "places": BinaryType()} | ({"decoded": StringType()} if decoded else {})
    kept = [c for c in docs.columns if c not in added]
    schema = StructType([docs.schema[c] for c in kept] + [StructField(n, t) for n, t in added.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(data)
        decoder = Decoder(encoder.model)
        head, tail = ([i] if marks else [] for i in (encoder.model.begin, encoder.model.end))
        for batch in batches:
            text = batch.schema.get_field_index("text")
            for part in _blocks(batch, text):
                found = encoder.encode_all([t or "" for t in part.column(text).to_pylist()])
                ids = [np.concatenate([head, i, tail]).astype("<u4") for i, _ in found]
                columns = {
                    "ids": pa.array([i.tobytes() for i in ids], pa.binary()),
                    "places": pa.array([p.tobytes() for _, p in found], pa.binary()),
                }
                if decoded:
                    columns["decoded"] = pa.array(decoder.decode_all(ids), pa.string())
                yield appended(part, kept, columns)
        encoder.clear()

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """The rows with ``decoded``, the text of ``ids``; a column of that name goes."""
    data = _model_bytes(model)
    kept = [c for c in encoded.columns if c != "decoded"]
    schema = StructType([encoded.schema[c] for c in kept] + [StructField("decoded", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(tools(data)[0])
        for batch in batches:
            ids = batch.schema.get_field_index("ids")
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [decoder.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in part.column(ids).to_pylist()]
                yield appended(part, kept, {"decoded": pa.array(texts, pa.string())})

    return encoded.mapInArrow(run, schema)


def encode_documents(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, with begin and end ids; and n_mapped.

    ``n_mapped`` is the number of bytes of the text under its pieces' spans: all of them. Null texts are empty ones;
    repeated rows and null ids are rows of their own.
    """
    encoded = encode(docs.select("doc_id", "text"), model, decoded=True)
    last = F.concat(*(F.substring("places", -i, 1) for i in range(1, 5)))  # big-endian
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.conv(F.hex(last), 16, 10).cast("long").alias("n_mapped"),
    )
