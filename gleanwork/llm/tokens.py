"""Token counts: batch encoding inside Arrow functions that return lengths only.

Texts of an Arrow batch are packed into encoder calls of about `batch_bytes` of UTF-8 each; a text above `piece_bytes` is split
before a single blank that stands between two letters, where no pre-token of the tokenizer's pattern can reach across, so the
pieces' counts add up to the count of the whole text. Texts are read whole. Sizes come from the Arrow offsets. Spark cuts files into tasks
by bytes too; a text is one row, so the longest one is the least that a task has. The rank file goes to the executors with the job.

Defined results: null text gives null, empty text 0; special-token strings inside a text are ordinary text; repeated rows
are counted each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from .runtime import isolated

#: Production parameters.
TOKENIZER = "byte_bpe_50k.tiktoken"
TOKENIZER_DIR = os.environ.get("GLEANWORK_TOKENIZERS", "/opt/tokenizers")
BATCH_BYTES, PIECE_BYTES = 1 << 20, 1 << 16
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SAFE = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")
_loaded: dict = {}


def encoder(path: str):
    """The tokenizer of a rank file, once per process."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def safe_pieces(raw: bytes, size: int) -> Iterator[str]:
    """Pieces of at least size bytes of UTF-8 (the last apart), cut only at safe boundaries; a text without one stays whole."""
    begin = 0
    look = size
    while len(raw) - look > 0:
        while raw[look] & 0xC0 == 0x80:  # inside a character
            look -= 1
        window = raw[look : look + (1 << 12)].decode("utf-8", "ignore")
        m = _SAFE.search(window)
        if m:
            cut = look + len(window[: m.start()].encode())
            yield raw[begin:cut].decode()
            begin, look = cut, cut + size
        elif look + (1 << 12) >= len(raw):
            break
        else:  # the next window begins two characters earlier, so that a boundary between the two is seen
            look += len(window[:-2].encode())
    yield raw[begin:].decode()


def count_batch(texts: pa.Array, path: str, batch_bytes: int = BATCH_BYTES, piece_bytes: int = PIECE_BYTES) -> np.ndarray:
    """Tokens of each text; 0 for null."""
    enc = encoder(path)
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    out = np.zeros(len(texts), np.int64)
    wave: list[str] = []
    owner: list[int] = []
    held = 0

    def flush() -> None:
        if wave:
            np.add.at(out, owner, [len(ids) for ids in enc.encode_ordinary_batch(wave, num_threads=1)])
        wave.clear()
        owner.clear()

    for k in np.flatnonzero(sizes).tolist():
        size, text = int(sizes[k]), texts[k]
        pieces = [(text.as_py(), size)] if size <= piece_bytes else ((p, len(p.encode())) for p in safe_pieces(text.as_buffer().to_pybytes(), piece_bytes))
        for piece, n in pieces:
            if held and held + n > batch_bytes:
                flush()
                held = 0
            wave.append(piece)
            owner.append(k)
            held += n
    flush()
    return out


@isolated
def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, directory: str = TOKENIZER_DIR, batch_bytes: int = BATCH_BYTES, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """doc_id and n_tokens of every document."""
    docs.sparkSession.sparkContext.addFile(os.path.join(directory, tokenizer))

    def run(batches):
        path = SparkFiles.get(tokenizer)
        for b in batches:
            text = b.column("text")
            counts = pa.array(count_batch(text, path, batch_bytes, piece_bytes), pa.int64(), mask=text.is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), counts], ["doc_id", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint")
