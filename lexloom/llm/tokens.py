"""Token counts by a public tokenizer, in Arrow batches. The vocabulary's path is a parameter; nothing is copied."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranks of the byte-level BPE with 50,256 ids; must be readable on every executor.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokenisation pattern published with that vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: White space as the pattern's engine sees it; longer runs than its stack bears are pre-tokenised here.
_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2000,}")


def length(text: str, path: str = VOCABULARY) -> int:
    """Tokens of a text. A run of white space is one piece but for its last character where something follows."""
    enc, n, at = encoding(path), 0, 0
    for m in _BLANKS.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        n += len(enc.encode_ordinary(text[at : m.start()])) + len(enc._core_bpe.encode_single_piece(text[m.start() : end].encode()))
        at = end
    return n + len(enc.encode_ordinary(text[at:] if at else text))


def count_tokens(df: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = (), path: str = VOCABULARY) -> DataFrame:
    """(id, *keep, tokens) for every row; null for a null text, 0 for an empty one. Narrow."""
    types = dict(df.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in (id_col, *keep)] + ["tokens long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [None if t is None else length(t, path) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(counts, pa.int64())], names=[id_col, *keep, "tokens"])

    picked = df.select(F.col(text_col).cast("string").alias("_text_"), id_col, *keep)
    return picked.mapInArrow(run, schema)
