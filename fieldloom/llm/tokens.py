"""Byte-level BPE ids with exact byte offsets, and tokens attributed to sections of a document.

A whole document is encoded once. Byte-level BPE loses nothing: the bytes of the tokens, one after
the other, are the bytes of the text. So running sums of the tokens' byte lengths are their spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesk
from .cut import small_batches

#: The pattern that splits text before byte pairs are merged, and the added token, as the vocabulary has them.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_OF_TEXT, END_OF_TEXT_ID = "<|endoftext|>", 50256
#: A text with a longer run without a change between letters, digits, others and white space goes to the slower library.
LONG_RUN = 1 << 14
_encoders: dict[str, tuple] = {}


def vocabulary() -> str:
    """The default vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str):
    """The encoder of a vocabulary file, text to ids, and the byte length of each id; loaded once in a Python worker.

    The same ids come from two libraries. The fast one's pattern engine recurses along a run of white space and fails on
    long ones, so texts with a long run go to the one the file is made for. The added token's string is that
    token wherever it stands.
    """
    if path not in _encoders:
        import json

        import tiktoken
        import tokenizers

        with open(path, encoding="utf-8") as f:
            words = json.load(f)["model"]["vocab"]
        ranks = {bytes(BYTE_OF[c] for c in word): k for word, k in words.items()}
        sizes = np.zeros(max(*ranks.values(), END_OF_TEXT_ID) + 1, np.int64)
        sizes[list(ranks.values())] = [len(k) for k in ranks]
        sizes[END_OF_TEXT_ID] = len(END_OF_TEXT)
        fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: END_OF_TEXT_ID})
        whole = tokenizers.Tokenizer.from_file(path)

        def encode(text: str) -> list[int]:
            if len(text) > LONG_RUN and longest_run(text) > LONG_RUN:
                return whole.encode(text, add_special_tokens=False).ids
            return fast.encode(text, allowed_special="all") if END_OF_TEXT in text else fast.encode_ordinary(text)

        _encoders[path] = encode, sizes
    return _encoders[path]


def byte_letters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from 256 on in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


BYTE_OF = byte_letters()
KIND = np.full(256, 3, np.uint8)  # bytes of other characters count as letters
KIND[:128] = 2
KIND[[*range(9, 14), 32, *range(28, 32)]] = 0
KIND[48:58] = 1
KIND[[*range(65, 91), *range(97, 123)]] = 3


def longest_run(text: str) -> int:
    """Bytes of the longest run of one kind of character; those beyond ASCII count as letters and as white space."""
    raw = np.frombuffer(text.encode(), np.uint8)
    longest = 0
    for kind in (KIND[raw], np.where(raw < 128, KIND[raw], 0)):
        edges = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        longest = max(longest, int(np.diff(np.concatenate([[0], edges, [len(raw)]])).max()))
    return longest


def attribute(sizes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and those of them that reach beyond it.

    sizes: byte lengths of a document's tokens in order; ends: ascending ends of its sections, which
    meet without gaps. The rule: a token belongs to the section that holds its first byte.
    """
    to = np.cumsum(sizes)
    at = np.searchsorted(ends, to - sizes, "right")
    crossing = to > ends[at]
    n = len(ends)
    return np.bincount(at, minlength=n), np.bincount(at[crossing], minlength=n)


def line_ends(raw: np.ndarray) -> np.ndarray:
    """Sections by default: the lines of a text, each with the line break that ends it; one empty section if there is nothing."""
    ends = np.flatnonzero(raw == 10) + 1
    return ends if len(ends) and ends[-1] == len(raw) else np.append(ends, len(raw))


def section_tokens(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None) -> DataFrame:
    """A row per line of each row of docs: doc_id, section (from 0), n_chars, n_tokens, n_crossing, doc_tokens.

    A line's characters include its line break. Tokens that cross a line's end count where they
    start, so the lines' tokens always add up to doc_tokens. Null and empty texts have one section
    without tokens; a text of any length is encoded whole. Ids are whole numbers, and may be null or
    repeat: each row of docs is handled by itself. An empty table gives no rows. Other columns aren't read.
    """
    path = path or vocabulary()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sizes = encoder(path)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = (value.as_py() or "").encode()
                data = np.frombuffer(raw, np.uint8)
                ends = line_ends(data)
                ids = np.asarray(encode(raw.decode()), np.int64)
                inside, crossing = attribute(sizes[ids], ends) if len(ids) else (np.zeros(len(ends), np.int64),) * 2
                chars = np.diff(bytesk.code_points(data)[np.append(0, ends)])
                for o, x in zip(out, (np.full(len(ends), 0 if key is None else key), np.arange(len(ends)), chars, inside, crossing, np.full(len(ends), len(ids))), strict=True):
                    o.append(x)
                if key is None:
                    out[0][-1] = np.ma.masked_all(len(ends), np.int64)
            if len(batch):
                ids = np.ma.concatenate(out[0])
                yield pa.RecordBatch.from_arrays([pa.array(ids.data, pa.int64(), mask=np.ma.getmaskarray(ids)), *[pa.array(np.concatenate(o), pa.int64()) for o in out[1:]]], names=["doc_id", "section", "n_chars", "n_tokens", "n_crossing", "doc_tokens"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, "doc_id long, section long, n_chars long, n_tokens long, n_crossing long, doc_tokens long")
