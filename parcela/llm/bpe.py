"""Byte-level BPE by the tiktoken library: encoding whole texts and decoding to raw bytes.

The ranks are a local file in tiktoken's format (base64 token, blank, rank). A long text is
cut before it goes to the library, at places where the pre-splitting pattern begins a match
in any case, so the ids are those of the uncut text.

Defined cases: a null text is encoded as the empty one; the empty text has no ids; rows that
repeat give repeated results; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import tiktoken
from pyspark.sql import DataFrame

from parcela.llm.common import texts_of

#: Characters that go to the library at once.
PIECE = 1 << 16

#: A blank between two ASCII letters or digits always begins a match of the pattern.
SAFE = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")

TYPES = {"n_tokens": "long", "ids": "array<int>", "decoded": "binary", "ids_sha256": "string", "decoded_sha256": "string"}


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def decimals(path: str, pattern: str) -> list[str]:
    return [str(i) for i in range(encoding(path, pattern).max_token_value + 1)]


def pieces(text: str, most: int = PIECE) -> Iterator[str]:
    """The text in parts of `most` characters or little more; a part without a safe place stays whole."""
    at = 0
    while len(text) - at > most:
        found = SAFE.search(text, at + most)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def encode(coder: tiktoken.Encoding, text: str) -> list[int]:
    if len(text) <= PIECE:
        return coder.encode_ordinary(text)
    return [i for part in pieces(text) for i in coder.encode_ordinary(part)]


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, columns: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """doc_id and the `columns` asked for, of TYPES: ids, the bytes they decode to, and digests of both.

    ids_sha256 is of the decimal ids joined by one blank, decoded_sha256 of the decoded bytes.
    """

    def run(batches):
        coder, names = encoding(ranks_path, pattern), decimals(ranks_path, pattern)
        for batch in batches:
            out: dict[str, list] = {c: [] for c in columns}
            for text in batch["text"]:
                ids = encode(coder, text)
                back = coder.decode_bytes(ids) if {"decoded", "decoded_sha256"} & {*columns} else b""
                for c in columns:
                    if c == "n_tokens":
                        out[c].append(len(ids))
                    elif c == "ids":
                        out[c].append(ids)
                    elif c == "decoded":
                        out[c].append(back)
                    elif c == "ids_sha256":
                        out[c].append(hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest())
                    else:
                        out[c].append(hashlib.sha256(back).hexdigest())
            yield pd.DataFrame({"doc_id": batch["doc_id"], **out})

    return texts_of(docs).mapInPandas(run, "doc_id long, " + ", ".join(f"{c} {TYPES[c]}" for c in columns))
