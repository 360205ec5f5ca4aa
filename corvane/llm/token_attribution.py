"""Token counts by offset-mapped attribution: whole texts are encoded once, and token spans meet section spans.

A section is a line: it ends after its line feed, and the rest after the last one, if any, is a section too.
A token's span runs from its first to its last byte. Spans of sections and tokens are both sorted and without gaps, so the interval
join is a search of each token's place among the sections' starts. The rule for a token that crosses a
boundary: it belongs to the section in which its first byte lies; `n_crossing` counts those that end in a
later section. So the counts of a document's sections add up to its tokens exactly.

Texts of any length are encoded whole. The library's pattern engine keeps a place for each blank of a run and dies of
very long ones, so a run of `LONG_RUN` blanks or more is given to it as the one unit that the pattern makes of it: all its
blanks at a text's end, else all but the last. Before a run and before that last blank the pattern always cuts, so the
tokens are the same.

Null or empty text has one empty section with no tokens. Repeated rows are counted alike; other columns
are not read; an empty table gives no rows. Special tokens' strings in a text are ordinary text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship_package
from .packing import tokenizer_path
from .support import documents, groups

RANKS = "byte_bpe_50k.tiktoken"
LONG_RUN = 100_000
#: What the tokenizer's pattern takes as blank.
_BLANK = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


class ByteTokens:
    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.length[i] = len(token)

    def ids(self, text: str) -> list[int]:
        """The library's tokens, with long runs of blanks apart."""
        if len(text) < LONG_RUN:
            return self.lib.encode_ordinary(text)
        out, at = [], 0
        # Only where a run begins, so that each run is read once.
        for m in re.finditer(f"(?<!{_BLANK}){_BLANK}{{{LONG_RUN},}}", text):
            end = m.end() if m.end() == len(text) else m.end() - 1
            out += self.lib.encode_ordinary(text[at : m.start()])
            out += self.lib._encode_single_piece(text[m.start() : end].encode())
            at = end
        return out + self.lib.encode_ordinary(text[at:])

    def ends(self, text: str) -> np.ndarray:
        """The byte after each token's last."""
        return np.cumsum(self.length[np.asarray(self.ids(text), np.int64)])


def sections(raw: bytes) -> np.ndarray:
    """Where each section starts, in bytes, and the text's length."""
    at = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    starts = np.concatenate([[0], at])
    if len(starts) > 1 and starts[-1] == len(raw):
        starts = starts[:-1]
    return np.append(starts, len(raw))


def attribute(ends: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and crossing tokens of each section, for tokens by their ends and sections by their bounds."""
    n = len(bounds) - 1
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    home = np.searchsorted(bounds[1:], starts, "right")
    last = np.searchsorted(bounds[1:], ends - 1, "right")
    return np.bincount(home, minlength=n)[:n], np.bincount(home[last > home], minlength=n)[:n]


_tokens: dict[str, ByteTokens] = {}


def tokens(path: str) -> ByteTokens:
    if path not in _tokens:
        _tokens[path] = ByteTokens(path)
    return _tokens[path]


OUT = pa.schema([("doc_id", pa.int64()), ("section", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("n_tokens", pa.int64()), ("n_crossing", pa.int64())])


def section_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None) -> DataFrame:
    """One row per section: its place, its span in characters, its tokens and those that cross its end."""
    ship_package(docs.sparkSession)
    path = ranks or tokenizer_path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokens(path)
        for whole in batches:
            for batch in groups(whole):
                parts = []
                for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    text = t or ""
                    raw = text.encode("utf-8", "replace")
                    bounds = sections(raw)
                    n, crossing = attribute(tok.ends(text), bounds)
                    # Bytes to characters: those that continue a character don't count.
                    chars = bounds if len(raw) == len(text) else np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])[bounds]
                    parts.append((doc, chars[:-1], chars[1:], n, crossing))
                sizes = [len(p[1]) for p in parts]
                ids = pa.array([p[0] for p in parts], pa.int64()).take(pa.array(np.repeat(np.arange(len(parts)), sizes)))
                place = np.concatenate([np.arange(s, dtype=np.int32) for s in sizes])
                yield pa.RecordBatch.from_arrays([ids, pa.array(place), *(pa.array(np.concatenate([p[k] for p in parts]).astype(np.int64)) for k in range(1, 5))], schema=OUT)

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, section int, start long, end long, n_tokens long, n_crossing long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(documents(spark, sf_dir))
