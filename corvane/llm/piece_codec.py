"""SentencePiece encoding and decoding of merge-type (BPE) models, by backtracking.

Merging by score gives the only sequence of pieces in which every two neighbours, joined and merged
again, come apart into themselves. So the encoder looks for such a sequence from the left: an
Aho-Corasick automaton gives the longest piece at each place; a piece that doesn't go with its
neighbour is replaced by the next shorter one; a place from which nothing leads on is marked in a
bitfield and never tried again. Pairs that have been checked are remembered.

No piece has a blank mark after another character, so a text falls apart before each blank mark that
follows a character, and each worker keeps a bounded cache of these words. Characters that are no
piece separate words too and become byte pieces. Runs of blanks are pieces of equal score, to which
the rule doesn't apply; they are merged directly, after the words beside them.

The model must leave texts as they are (no case folding or composition) and put a blank first; this is tried at
load on `PROBES`, and another model is refused. Null text is empty and gives the end id alone. Repeated rows and texts of any length are encoded
whole; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship_package
from .packing import tokenizer_path
from .support import documents, groups

MODEL = "piece_bpe_32k.model"
BLANK = "▁"
_SEPARATOR = "\x00"
#: Texts on which a model must agree with the codec: case, composition, ligatures, runs of blanks, marks and bytes.
PROBES = ("Mixed CASE words, and a stop.", "ﬁ ① Å A\u030a ½ ＡＢ", "  two  lead and trail  ", "日本 😀 \t tab\nline", " ", "")
_CACHE_ENTRIES = 400_000
_PAIR_ENTRIES = 400_000


class PieceCodec:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        self.end = lib.eos_id()
        self.byte_ids = {}
        self.piece: list[str | None] = [None] * n
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte_of: dict[int, int] = {}
        for i in range(n):
            p = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
                self.byte_of[i] = int(p[3:5], 16)
            elif not lib.is_control(i) and not lib.is_unknown(i):
                self.piece[i] = p
                self.ids[p] = i
                self.score[p] = lib.get_score(i)
        self.unknown = lib.unk_id()
        #: Text of each id; None for bytes.
        self.text = [None if i in self.byte_of else p.replace(BLANK, " ") if p is not None else " ⁇ " if i == self.unknown else "" for i, p in enumerate(self.piece)]
        # Pieces that merging can arrive at; others never occur. Runs of blanks are handled apart.
        reached = [p for p in self.ids if p.strip(BLANK) and (len(p) == 1 or self.merge(p) == [p])]
        reached.append(BLANK)
        self.auto = ahocorasick.Automaton()
        for p in reached:
            self.auto.add_word(p, (len(p) - 1, p))
        self.auto.make_automaton()
        # For each piece, the longest shorter piece that it starts with.
        known = set(reached)
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in known), None) for p in reached}
        singles = "".join(re.escape(p) for p in self.ids if len(p) == 1)
        self.known_runs = re.compile(f"[{singles}]+|[^{singles}]+")
        self.single = {p for p in self.ids if len(p) == 1}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words: dict[str, str] = {}  # a word's ids as text, each with a blank after it
        self.older: dict[str, str] = {}
        self.odd: dict[str, str] = {}  # decoded texts of the words that don't come back as they were
        # Characters that stand before a stop or comma in some piece; after any other, a token ends.
        joined = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        before = "".join(re.escape(x[0]) for x in joined if x[1] in ".,")
        self.mark_may_join = re.compile(f"(?:^|[{before}])[.,][\x00\n]")
        self.blank_runs: dict[int, list[str]] = {}
        # What is assumed of the model, above all that it leaves texts as they are, holds on texts that would show otherwise.
        for t in PROBES:
            ids = lib.encode(t, add_eos=True)
            if self.encode(t) != ids or self.decode(ids) != lib.decode(ids):
                raise ValueError(f"{path} changes texts or merges in another way than this codec supports")

    def merge(self, text: str) -> list[str]:
        """Pieces of text by repeatedly merging the neighbours whose union scores highest, the leftmost first."""
        parts: list[str | None] = list(text)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        score, heap = self.score, []
        for i in range(len(parts) - 1):
            if (s := score.get(text[i : i + 2])) is not None:
                heap.append((-s, i, text[i : i + 2]))
        heapq.heapify(heap)
        while heap:
            _, i, union = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else len(parts)
            if j >= len(parts) or parts[i] + parts[j] != union:
                continue
            parts[i], parts[j] = union, None
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(parts) and (s := score.get(u := parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (-s, a, u))
        return [p for p in parts if p is not None]

    def together(self, left: str, right: str) -> bool:
        """Whether merging the two joined gives the two again."""
        key = (left, right)
        if (found := self.pairs.get(key)) is None:
            if len(self.pairs) > _PAIR_ENTRIES:
                self.pairs.clear()
            found = self.pairs[key] = self.merge(left + right) == [left, right]
        return found

    def backtrack(self, text: str) -> list[str]:
        """Pieces of a text whose characters are all pieces and in which no two blanks meet."""
        longest: list[str | None] = [None] * len(text)
        for end, (back, p) in self.auto.iter(text):
            longest[end - back] = p  # matches come by their ends, so the last is the longest
        open_places = bytearray(b"\xff") * (len(text) // 8 + 1)
        out: list[str] = []
        at, piece = 0, longest[0] if text else None
        pairs, together = self.pairs, self.together
        while piece is not None:
            end = at + len(piece)
            if open_places[end >> 3] >> (end & 7) & 1 and (not out or pairs.get(key := (out[-1], piece)) or key not in pairs and together(*key)):
                out.append(piece)
                at = end
                piece = longest[at] if at < len(text) else None
            elif (less := self.shorter[piece]) is not None:
                piece = less
            else:
                open_places[at >> 3] &= ~(1 << (at & 7)) & 0xFF
                piece = out.pop()
                at -= len(piece)
        return out

    def run_of_blanks(self, n: int) -> list[str]:
        if n not in self.blank_runs:
            if len(self.blank_runs) > 1000:
                self.blank_runs.clear()
            self.blank_runs[n] = self.merge(BLANK * n)
        return self.blank_runs[n]

    def word_ids(self, word: str) -> list[int]:
        """Ids of a text in which blank marks stand at the start only."""
        if (letters := word[1:]).isascii() and letters.isalpha() and word[0] == BLANK:
            return [self.ids[p] for p in self.backtrack(word)]
        out: list[int] = []
        for run in self.known_runs.findall(word):
            if run[0] not in self.single:
                out += [self.byte_ids[b] if self.byte_ids else self.unknown for b in run.encode("utf-8", "replace")]
                continue
            blanks = len(run) - len(run.lstrip(BLANK))
            parts = self.backtrack(run[max(0, blanks - 1) :])
            if blanks > 1:
                lead = blanks - 1
                if parts[0] == BLANK:
                    lead, parts = blanks, parts[1:]
                parts = self.run_of_blanks(lead) + parts
            out += [self.ids[p] for p in parts]
        return out

    def normalise(self, text: str) -> str:
        """A blank before the text, and blank marks for blanks."""
        return (" " + text).replace(" ", BLANK) if text else ""

    def split(self, text: str) -> list[str]:
        """The words of a normalised text; joined, they are the text."""
        return re.findall(f"{BLANK}+[^{BLANK}]*", text)

    def encode(self, text: str) -> list[int]:
        """Ids of text and the end id."""
        return [i for w in self.split(self.normalise(text)) for i in self.word_ids(w)] + [self.end]

    def decode_parts(self, ids: list[int]) -> str:
        """Text of ids, with its leading blank. Bytes are read as UTF-8; those that aren't give U+FFFD."""
        try:
            return "".join([self.text[i] for i in ids])
        except TypeError:  # a byte
            pass
        out, held = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(self._from_bytes(held))
                held = bytearray()
            out.append(self.text[i])
        if held:
            out.append(self._from_bytes(held))
        return "".join(out)

    @staticmethod
    def _from_bytes(held: bytearray) -> str:
        return bytes(held).decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        """Text of ids; the blank that encoding put first goes."""
        return self.decode_parts(ids).removeprefix(" ")

    def word(self, word: str) -> str:
        """Ids of a word as text. They are decoded, and the word is noted as odd if that gives another text."""
        if (found := self.older.get(word)) is None:
            ids = self.word_ids(word)
            found = "".join([f"{i} " for i in ids])
            if (back := self.decode_parts(ids)) != word.replace(BLANK, " "):
                self.odd[word] = back
        self.words[word] = found
        return found

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Of each text: number of ids, SHA-256 of the ids, SHA-256 of the decoded text.

        The different words of a batch are found by Arrow, so Python looks each up once.
        """
        if len(self.words) > _CACHE_ENTRIES:
            self.words, self.older = {}, self.words
        if len(self.odd) > _CACHE_ENTRIES:
            self.words, self.older, self.odd = {}, {}, {}
        plain = ["" if _SEPARATOR in t else self.cut(t) for t in texts]
        cut = pc.split_pattern(pa.array(plain, pa.large_string()), _SEPARATOR)
        encoded = cut.flatten().dictionary_encode()
        words = encoded.dictionary.to_pylist()
        ids = list(map(self.words.get, words))
        for k, d in enumerate(ids):
            if d is None:
                ids[k] = self.word(words[k])

        bounds = cut.offsets.to_numpy()

        def joined(values: list[str]) -> list[bytes]:
            """The values of each text's words end to end, which is how Arrow lays them out."""
            own = pa.array(values, pa.large_string()).take(encoded.indices)
            _, ends, data = own.buffers()
            at = np.frombuffer(ends, np.int64)[bounds]
            data = memoryview(data) if data is not None else b""
            return [bytes(data[x:y]) for x, y in zip(at.tolist(), at[1:].tolist())]

        out = []
        for text, i, t in zip(texts, joined(ids), joined([self.odd.get(w, w) for w in words] if self.odd else words)):
            if _SEPARATOR in text:  # the only texts that can't be cut by it
                own = self.encode(text)[:-1]
                i, t = "".join([f"{x} " for x in own]).encode(), self.decode_parts(own).encode("utf-8", "replace")
            i += str(self.end).encode()
            t = t.replace(BLANK.encode(), b" ").removeprefix(b" ")
            out.append((i.count(b" ") + 1, hashlib.sha256(i).hexdigest(), hashlib.sha256(t).hexdigest()))
        return out

    def digest(self, text: str) -> tuple[int, str, str]:
        return self.digests([text])[0]

    def cut(self, text: str) -> str:
        """The normalised text, with separators where no token spans: between words, and around the stop or comma after them."""
        if not text:
            return ""
        if BLANK in text or "  " in text or text[:1] == " ":
            return _SEPARATOR.join(self.split(self.normalise(text)))
        text = (" " + text).replace(" ", _SEPARATOR + BLANK)
        if self.mark_may_join.search(text):
            return text[1:]
        # A line feed is no piece, so tokens end at both its sides.
        for old, new in ((".|", "|.|"), (",|", "|,|"), (".\n", "|.|\n"), ("\n", "|\n|")):
            text = text.replace(old.replace("|", _SEPARATOR), new.replace("|", _SEPARATOR))
        return text[1:]


_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """Per document: the number of ids, and digests of the ids and of the text that they decode to."""
    ship_package(docs.sparkSession)
    path = model or tokenizer_path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for whole in batches:
            for batch in groups(whole, 10_000_000):
                rows = c.digests([t or "" for t in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(list(x), f.type) for x, f in zip(zip(*rows), list(OUT)[1:]))], schema=OUT)

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """Per document: its ids and the text that they decode to."""
    ship_package(docs.sparkSession)
    path = model or tokenizer_path(MODEL)
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for whole in batches:
            for batch in groups(whole):
                ids = [c.encode(t or "") for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([c.decode(x) for x in ids], pa.string())], schema=out)

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(documents(spark, sf_dir))
