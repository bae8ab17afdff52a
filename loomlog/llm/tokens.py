"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vocabulary file; read where it lies on each machine, never copied.
VOCABULARY = os.environ.get("LOOMLOG_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: how byte-level BPE vocabularies of this kind split a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
_loaded: dict = {}


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to their numbers of tokens; special strings are ordinary text.

    ``.tiktoken`` files are rank lists of a byte-level BPE, ``.json`` files
    describe a whole tokenizer. Loaded once per worker function.
    """
    if path not in _loaded:
        if path.endswith(".json"):
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.encode_special_tokens = True
            _loaded[path] = lambda texts: [len(e) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            e = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            _loaded[path] = lambda texts: [len(e.encode_ordinary(x)) for x in texts]
    return _loaded[path]


def with_tokens(docs: DataFrame, text: str = "text", to: str = "n_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """Replace column ``text`` by the number of tokens of the whole text; 0 for null and empty texts."""
    rest = [c for c in docs.columns if c not in (text, to)]
    shaped = docs.select(*rest, F.coalesce(F.col(text), F.lit("")).alias(text))
    schema = shaped.drop(text).withColumn(to, F.lit(0).cast("bigint")).schema

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measured = counter(vocabulary)
        for b in batches:
            texts, n = b.column(b.num_columns - 1).to_pylist(), []
            at = 0
            while at < len(texts):  # by size, so that a batch of very long texts needs no more memory
                end, chars = at, 0
                while end < len(texts) and chars < 1_000_000:
                    chars += len(texts[end])
                    end += 1
                n += measured(texts[at:end])
                at = end
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*rest, to])

    return shaped.mapInArrow(measure, schema)
