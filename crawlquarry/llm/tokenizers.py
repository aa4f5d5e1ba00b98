"""Public tokenizers by name, from vocabulary files whose folder is a parameter. Nothing is trained or copied here."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable
from functools import cache

from pyspark import SparkFiles
from pyspark.sql import SparkSession

#: Folder on the driver; where executors lack it, they take the files that :func:`ship` gave them.
DEFAULT_DIR = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
#: The pattern that splits text before the merges of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Vocabularies that split by PATTERN: for these a chunk may end before a space that is followed by no space.
BYTE_LEVEL = ("byte_bpe_50k", "byte_bpe_multi_50k")


ENDS = (".tiktoken", ".model", ".json")


def ship(spark: SparkSession, names: list[str], folder: str = DEFAULT_DIR) -> None:
    """Give vocabulary files to all executors, each once per application."""
    sc = spark.sparkContext
    done = sc.__dict__.setdefault("_crawlquarry_vocabularies", set())
    for path in (os.path.join(folder, n + end) for n in names for end in ENDS):
        if path not in done and os.path.exists(path):
            sc.addFile(path)
            done.add(path)


def _file(name: str, end: str, folder: str) -> str | None:
    path = os.path.join(folder, name + end)
    if os.path.exists(path):
        return path
    try:
        path = SparkFiles.get(name + end)
    except Exception:  # outside of a session and of a task
        return None
    return path if os.path.exists(path) else None


@cache
def encoder(name: str, folder: str = DEFAULT_DIR) -> Callable[[list[str]], list[list[int]]]:
    """Texts to ids, without special tokens; their strings in a text are ordinary text."""
    if name in BYTE_LEVEL:
        import tiktoken

        path = _file(name, ".tiktoken", folder)
        if path is None:
            raise ValueError(f"no tokenizer {name!r} in {folder}")
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        own = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [own.encode_ordinary(t) for t in texts]
    for end in (".model", ".json"):
        if path := _file(name, end, folder):
            break
    else:
        raise ValueError(f"no tokenizer {name!r} in {folder}")
    if end == ".model":
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: pieces.encode(texts, num_threads=1)
    import tokenizers

    words = tokenizers.Tokenizer.from_file(path)
    words.encode_special_tokens = True
    return lambda texts: [e.ids for e in words.encode_batch(texts, add_special_tokens=False)]
