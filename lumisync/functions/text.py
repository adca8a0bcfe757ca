"""Text clean-up and pre-tokenisation, all in JVM regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two special tokens and the token pattern.
BOS = "<|startoftext|>"
EOS = "<|endoftext|>"
TOKEN_PATTERN = r"<\|startoftext\|>|<\|endoftext\|>|'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


# The same tokens for Java's matcher: what begins alike is one alternative, runs give nothing back, and
# only the fixed spellings are matched without regard to case.
_JAVA_PATTERN = r"(?U)\p{L}++|\p{N}|(?i:<\|startoftext\|>|<\|endoftext\|>|'(?:s|t|re|ve|m|ll|d))|[^\s\p{L}\p{N}]++"


def normalize_text(text: Column) -> Column:
    """Lower-case and squeeze every run of Unicode whitespace to one space; no trim."""
    return F.regexp_replace(F.lower(text), r"(?U)\s+", " ")


def pretokenize(text: Column) -> Column:
    """Split normalised text into words, single digits, contractions and symbol runs."""
    return F.regexp_extract_all(text, F.lit(_JAVA_PATTERN), F.lit(0))


def hash_buckets(tokens: Column, n: int) -> Column:
    """Bucket number per token from the first 32 bits of its MD5."""
    def bucket(token: Column) -> Column:
        head = F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("bigint")
        return F.pmod(head, F.lit(n)).cast("int")
    return F.transform(tokens, bucket)
