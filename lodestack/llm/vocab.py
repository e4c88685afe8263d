"""Public tokenizer vocabularies, loaded once per Python worker from a folder given as parameter."""

from __future__ import annotations

import base64
from functools import lru_cache

TOKENIZER_FOLDER = "/opt/tokenizers"
BPE_FILE = "byte_bpe_50k.tiktoken"
# Fixed value: how texts are parted before the byte pairs of this vocabulary are merged.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def _counter(path: str):
    """A function from texts to their numbers of tokens; special tokens' strings are ordinary text."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}
        encode = tiktoken.Encoding(path, pat_str=PARTS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return lambda texts: [len(encode(t)) for t in texts]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def token_counts(texts: list[str], folder: str = TOKENIZER_FOLDER, file: str = BPE_FILE) -> list[int]:
    """Tokens of each text in the vocabulary ``file``; special tokens' strings count as ordinary text."""
    return _counter(f"{folder}/{file}")(texts)


def chars_per_subword(text: str, folder: str = TOKENIZER_FOLDER, file: str = BPE_FILE) -> float:
    """Natural words take few subwords for their length, random strings many; 0 for an empty text."""
    return len(text) / max(1, token_counts([text], folder, file)[0])
