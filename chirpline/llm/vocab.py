"""Where the vocabulary files of the public tokenizers are."""

from __future__ import annotations


def rank_file(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """Path of a rank file and the pattern that splits text before its merges."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN
