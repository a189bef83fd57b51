"""Token counts with the vocabulary file of a public byte-level tokenizer.

The place of the file is a parameter; nothing of it is kept here. Every token stands for at least one byte, so a text of n bytes
has at most n tokens: texts that can't exceed a limit needn't be encoded to know that.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that cuts text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str = VOCABULARY):
    """The encoder of a rank file; one per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def counter(path: str = VOCABULARY):
    """A function from text to its number of tokens."""
    core = encoder(path)._core_bpe
    plain = encoder(path).encode_ordinary

    def count(text: str) -> int:
        if not text:
            return 0
        try:
            return len(core.encode_ordinary(text))
        except UnicodeEncodeError:
            return len(plain(text))

    return count


def with_tokens(df: DataFrame, text: str = "text", out: str = "n_tokens", vocabulary: str = VOCABULARY, skip_bytes: int = 0) -> DataFrame:
    """``df`` with ``text`` replaced by its number of tokens in ``out``; the other columns pass through.

    A null text has 0 tokens. Texts of at most ``skip_bytes`` bytes get their number of bytes, an upper bound, with its sign
    turned; they aren't encoded. A column already named ``out`` is replaced.
    """
    keep = [c for c in df.columns if c not in (text, out)]
    need = F.octet_length(F.coalesce(F.col(text), F.lit(""))) > skip_bytes
    source = df.select(*keep, F.octet_length(F.coalesce(F.col(text), F.lit(""))).alias(out), F.when(need, F.col(text)).alias("__text"))
    schema = source.drop("__text").withColumn(out, F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for b in batches:
            sizes = [count(t) if t is not None else (-n if n and skip_bytes else 0) for t, n in zip(b.column("__text").to_pylist(), b.column(out).to_pylist())]
            cols = {c: b.column(c) for c in keep} | {out: pa.array(sizes, pa.int64())}
            yield pa.RecordBatch.from_pydict({f.name: cols[f.name] for f in schema})

    return source.mapInArrow(run, schema)
