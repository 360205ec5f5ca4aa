"""Best-fit packing: documents as token ids, cut into pieces, placed into sequences of a fixed length.

Each task packs its own rows in one pass with a fixed number of open bins. A bitset keyed by free
space finds the tightest open bin that holds a piece; where none does, a new bin opens, and when too
many are open the fullest closes. A placed piece is final, so rows leave at once and a task holds
the open bins only. Sequence ids combine the task's partition with a counter.

Null text is empty: the document is its end id alone. Documents longer than a sequence are cut from
the front into full sequences and a rest. Repeated rows are packed once each. Other columns are not
read. Text of any length is encoded whole: tokens never span ASCII blanks, so it is encoded chunk by
chunk between blanks, and each worker keeps a bounded cache of chunks. That holds for tokenizers that lower
case and drop blanks; it is tried at load on `PROBES`, and another tokenizer is refused.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship_package
from .support import documents, groups

SEQUENCE = 4096
END_ID = 1
OPEN_BINS = 64
#: Bytes of text that are encoded at once: what the tokenizer holds for each is a hundred times as much.
BATCH_BYTES = 2_000_000
TOKENIZER = "word_bpe_49k.json"
#: Chunks that a worker keeps, twice: workers live on in the stages after, and each chunk takes 200 bytes.
_CACHE_ENTRIES = 150_000
#: Texts on which a tokenizer must give what the chunks of the text give one by one.
PROBES = ("Mixed CASE Words, and a stop. Next\nline...  two blanks\tand a tab", "ÀÉ Straße ΣΣ日本 x9 12.5 it's DON'T a.b,c", " lead , . trail ", "a\u0301 \xa0 end.\n")
#: A full stop or comma that is not alone after a letter or digit belongs to a run of marks, which is one token's matter.
_RUN_OF_MARKS = re.compile(r"[.,](?<=[\W_][.,])\s")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkEncoder:
    """Token ids of whole texts as little-endian 32-bit words, through a cache of blank-free chunks.

    The tokenizer reads lower case, and a mark after a letter is a token of its own kind. So Latin texts are
    looked up in lower case, with the stop or comma after a word as its own chunk; that makes fewer chunks.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.model = self.lib.model
        # The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        self.letter_of = {b: chr(256 + k) for k, b in enumerate(others)}
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # What is assumed of the tokenizer holds on texts that would show otherwise.
        if any(np.frombuffer(got, "<u4").tolist() != self.lib.encode(t, add_special_tokens=False).ids for t, got in zip(PROBES, self.encode(list(PROBES)))):
            raise ValueError(f"{path} reads case, blanks or marks in another way than packing supports")

    def _encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each chunk. A lower-case Latin word is one piece for the model, without the steps before it."""
        out: list[bytes | None] = [None] * len(texts)
        rest = []
        tokenize = self.model.tokenize
        for k, c in enumerate(texts):
            if c.isalpha() and c.islower() and _latin(c):
                letters = c if c.isascii() else c.encode().decode("latin-1").translate(self.letter_of)
                out[k] = array("I", [t.id for t in tokenize(letters)]).tobytes()
            else:
                rest.append(k)
        for k, e in zip(rest, self.lib.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False)):
            out[k] = array("I", e.ids).tobytes()
        return out

    @staticmethod
    def prepared(text: str) -> str:
        """A text whose parts between ASCII blanks have, one after the other, the ids of the text itself."""
        if "<|" not in text and _latin(text):
            text = text.lower()
            if not _RUN_OF_MARKS.search(text):
                text = text.replace(". ", " . ").replace(", ", " , ").replace(".\n", " . ")
        return text

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as the tokenizer gives them without special tokens.

        A batch is cut into chunks and its different chunks are found by Arrow, so Python looks each up once.
        """
        if len(self.cache) > _CACHE_ENTRIES:
            self.cache, self.older = {}, self.cache
        cut = pc.ascii_split_whitespace(pa.array([self.prepared(t) for t in texts], pa.large_string()))
        encoded = cut.flatten().dictionary_encode()
        chunks, codes = encoded.dictionary.to_pylist(), encoded.indices.to_numpy()
        found = list(map(self.cache.get, chunks))
        todo = [k for k, v in enumerate(found) if v is None]
        new = []
        for k in todo:
            if (v := self.older.get(chunks[k])) is None:
                new.append(k)
            else:
                found[k] = self.cache[chunks[k]] = v
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            for k, v in zip(part, self._encode([chunks[k] for k in part])):
                found[k] = self.cache[chunks[k]] = v
        # Ids of the different chunks end to end, then gathered in the order of the texts.
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts = np.cumsum(sizes) - sizes
        ids = np.frombuffer(b"".join(found), "<u4")
        each = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(each)])
        gathered = ids[np.repeat(starts[codes] - ends[:-1], each) + np.arange(ends[-1])]
        bounds = ends[cut.offsets.to_numpy()]
        return [gathered[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]


def _latin(text: str) -> bool:
    """Whether all characters are of Latin-1, in which lower case and composition are plain."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One per worker process, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


class BoundedBestFit:
    """Online best fit into bins of one size, with at most open_bins of them open."""

    def __init__(self, size: int, open_bins: int, first_id: int = 0):
        self.size, self.limit, self.next_id = size, open_bins, first_id
        self.bits = 0  # bit f is set if an open bin has free space f
        self.bins: dict[int, list[int]] = {}
        self.n_open = 0

    def place(self, length: int) -> tuple[int, int]:
        """Bin and offset for a piece of 1 to size tokens."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            at = self._take(free)
        else:
            free, at = self.size, self.next_id
            self.next_id += 1
            if length < self.size and self.n_open >= self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
        if left := free - length:
            self.bins.setdefault(left, []).append(at)
            self.bits |= 1 << left
            self.n_open += 1
        return at, self.size - free

    def _take(self, free: int) -> int:
        same = self.bins[free]
        at = same.pop()
        if not same:
            del self.bins[free]
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return at


OUT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
    ]
)
DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pieces(ids: bytes, size: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, crc32) of each piece of a document's ids."""
    n = len(ids) // 4
    for start in range(0, n, size):
        part = ids[4 * start : 4 * min(n, start + size)]
        yield start, len(part) // 4, zlib.crc32(part)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE, open_bins: int = OPEN_BINS, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece; with_ids adds the ids themselves as array<int> `ids`."""
    ship_package(docs.sparkSession)
    path = tokenizer or tokenizer_path(TOKENIZER)
    schema = OUT.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else OUT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(path)
        fit = BoundedBestFit(size, open_bins, TaskContext.get().partitionId() << 33)
        end = END_ID.to_bytes(4, "little")
        for whole in batches:
            for batch in groups(whole, BATCH_BYTES):
                rows = []
                for doc, ids in zip(batch.column(0).to_pylist(), enc.encode([t or "" for t in batch.column(1).to_pylist()])):
                    ids += end
                    for k, (start, n, crc) in enumerate(pieces(ids, size)):
                        at, offset = fit.place(n)
                        row = (doc, k, start, n, crc, at, offset)
                        rows.append((*row, memoryview(ids[4 * start : 4 * (start + n)]).cast("i").tolist()) if with_ids else row)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(id_col, text_col).mapInArrow(run, DDL + (", ids array<int>" if with_ids else ""))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
