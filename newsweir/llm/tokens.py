"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweir.operators.partitions import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the published split pattern of this family of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WHOLE = 1 << 40
_CACHE = 1_000_000


class _Pieces(dict):
    """Tokens of a blank followed by a piece, remembered; _WHOLE more if the piece can't be counted alone."""

    def __init__(self, encoding):
        super().__init__()
        self.encoding = encoding

    def __missing__(self, piece: str) -> int:
        if len(self) > _CACHE:
            self.clear()
        n = _WHOLE if not piece or piece[0].isspace() else len(self.encoding.encode_ordinary(" " + piece))
        if len(piece) <= 64:
            self[piece] = n
        return n


class TokenCounter:
    """Counts the tokens of texts.

    The pattern begins a new unit at every blank that stands before something other than white space, so
    a text's count is the sum over its blank-separated pieces, and words that return are counted once. A
    text with a blank before white space is encoded as a whole.
    """

    def __init__(self, vocabulary: str = VOCABULARY):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = _Pieces(self.encoding)

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        first, _, rest = text.partition(" ")
        n = len(self.encoding.encode_ordinary(first))
        if rest or _:
            n += sum(map(self.pieces.__getitem__, rest.split(" ")))
        return n if first and n < _WHOLE else len(self.encoding.encode_ordinary(text))


def with_tokens(df: DataFrame, text: str, name: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """`df` with the text column replaced by its number of tokens; null and empty texts have 0."""
    others = [c for c in df.columns if c != text]
    schema = df.select(*others).withColumn(name, F.lit(0).cast("long")).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(vocabulary)
        for b in batches:
            n = pa.array([counter(t) for t in b.column(len(others)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(others)], n], [*others, name])

    return spread(df.select(*others, text)).mapInArrow(count, schema)
