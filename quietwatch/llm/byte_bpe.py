"""Byte-level BPE through tiktoken, with a local rank file and raw-byte decoding."""

from __future__ import annotations

import base64
import hashlib

import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietwatch.llm.common import map_batches

#: Texts above this many characters are cut before they reach the library.
SPLIT_CHARS = 20_000

#: A run of white space above this many characters goes round the library's regular expression.
LONG_BLANK = 2_000

# A word or number ends where ASCII white space begins: no match of the splitting pattern spans that place, and
# none looks beyond it, so both sides encode by themselves.
_SAFE = regex.compile(r"(?<=[\p{L}\p{N}])(?=[ \n\r\t])")
_BLANK = regex.compile(r"[ \n\r\t]{%d,}" % LONG_BLANK)

_ENCODINGS: dict[tuple[str, str], tiktoken.Encoding] = {}


def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file, loaded once per Python worker."""
    key = (ranks_path, pattern)
    if key not in _ENCODINGS:
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        _ENCODINGS[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[key]


def safe_parts(text: str, size: int = SPLIT_CHARS):
    """Cuts of a long text at safe boundaries, each of about ``size`` characters; a run without one stays whole."""
    at = 0
    while len(text) - at > size:
        found = _SAFE.search(text, at + size)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def _white(letter: str) -> bool:
    r"""White space as the library's ``\s`` has it: unlike Python's it leaves out U+001C to U+001F."""
    return letter.isspace() and letter not in "\x1c\x1d\x1e\x1f"


def encode(enc: tiktoken.Encoding, text: str, size: int = SPLIT_CHARS) -> list[int]:
    """Ids of a text, the same as the library gives for the whole of it."""
    if len(text) <= min(size, LONG_BLANK):
        return enc.encode_ordinary(text)
    ids: list[int] = []
    at = 0
    for blank in _BLANK.finditer(text):
        # the run before a word is one match but for its last character; at the end of the text it is one match
        stop = blank.end() if blank.end() == len(text) else blank.end() - 1
        start = blank.start()
        while start > at and _white(text[start - 1]):
            start -= 1
        if stop < len(text) and (text[stop + 1].isspace() or text[stop + 1] in "\x1c\x1d\x1e\x1f"):
            continue  # other white space follows: leave it to the library
        for part in safe_parts(text[at:start], size):
            ids += enc.encode_ordinary(part)
        ids += enc._encode_single_piece(text[start:stop])
        at = stop
    for part in safe_parts(text[at:], size):
        ids += enc.encode_ordinary(part)
    return ids


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"):
    """One row per document: ``doc_id`` and ``ids``, little-endian unsigned 32-bit numbers in one binary.

    The whole text is encoded, without special tokens; a null or empty text has no ids.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batch):
        import numpy as np

        enc = encoding(ranks_path, pattern)
        ids = [np.array(encode(enc, t or ""), "<u4").tobytes() for t in batch["text"]]
        return {"doc_id": batch["doc_id"], "ids": ids}

    return map_batches(rows, run, f"doc_id {id_type}, ids binary")


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``encoded`` with ``bytes``: the raw bytes of the ids, which need not be whole characters.

    Null ids decode to null.
    """
    id_type = encoded.schema["doc_id"].dataType.simpleString()

    def run(batch):
        import numpy as np

        enc = encoding(ranks_path, pattern)
        out = [None if b is None else enc.decode_bytes(np.frombuffer(b, "<u4").tolist()) for b in batch["ids"]]
        return {"doc_id": batch["doc_id"], "ids": batch["ids"], "bytes": out}

    return map_batches(encoded.select("doc_id", "ids"), run, f"doc_id {id_type}, ids binary, bytes binary")


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
