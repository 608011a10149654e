"""Token counts, ids and byte spans with existing tokenizer libraries, as Arrow UDFs.

A tokenizer is loaded on the driver, sent once to each executor as a broadcast, and
built once per task.  Texts are encoded run by run (:mod:`linewright.functions.batches`): a token
takes some hundred bytes in Python, so only the tokens of one run are held at a time.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import partial
from itertools import chain
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from linewright.functions.batches import runs

TIKTOKEN, HUGGINGFACE, GPT2 = "tiktoken", "huggingface", "gpt2"

# Bytes of text encoded at once, unless a single text has more.
ENCODED_BYTES = 1 << 17

# Accepted spellings of backends and encodings.
BACKENDS = {
    "tiktoken": TIKTOKEN,
    "tk": TIKTOKEN,
    "openai": TIKTOKEN,
    "huggingface": HUGGINGFACE,
    "hf": HUGGINGFACE,
    "llama": HUGGINGFACE,
    "gpt2": GPT2,
    "gpt-2": GPT2,
    "legacy": GPT2,
}
ENCODINGS = {
    "cl100k_base": "cl100k_base",
    "cl100k": "cl100k_base",
    "gpt4": "cl100k_base",
    "p50k_base": "p50k_base",
    "p50k": "p50k_base",
    "codex": "p50k_base",
    "r50k_base": "r50k_base",
    "r50k": "r50k_base",
    "gpt3": "r50k_base",
}


def parse_backend(name: str) -> str | None:
    return BACKENDS.get(name.lower())


def parse_encoding(name: str) -> str | None:
    return ENCODINGS.get(name.lower())


@dataclass(frozen=True)
class Tokenizer:
    """A tokenizer ready to be used in column functions."""

    name: str
    kind: str
    payload: Broadcast

    def ids(self) -> Callable[[list[str]], list[list[int]]]:
        """A function from texts to token ids, built in the task."""
        if self.kind == TIKTOKEN:
            encoding = _tiktoken(self.payload.value)
            return lambda texts: [encoding.encode(text, allowed_special="all") for text in texts]
        tokenizer = _huggingface(self.payload.value)
        return lambda texts: [
            found.ids for found in tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ]

    def spans(self, shown: bool = True) -> Callable[[list[str]], list[tuple]]:
        """A function from texts to ``(ids, byte spans, token texts)``, built in the task.

        The spans are an array of starts and ends; without ``shown`` there are no token texts.
        """
        if self.kind == TIKTOKEN:
            encoding = _tiktoken(self.payload.value)
            return lambda texts: [_tiktoken_spans(encoding, text, shown) for text in texts]
        tokenizer = _huggingface(self.payload.value)
        return lambda texts: [
            (found.ids, _byte_spans(text, found.offsets), found.tokens if shown else [])
            for text, found in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False))
        ]


def _tiktoken(parts: dict):
    import tiktoken

    return tiktoken.Encoding(**parts)


def _huggingface(definition: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
    import tokenizers

    return tokenizers.Tokenizer.from_str(definition)


def _tiktoken_spans(encoding, text: str, shown: bool) -> tuple:
    """Spans from token lengths; a token that ends inside a character shows a replacement."""
    ids = encoding.encode(text, allowed_special="all")
    pieces = encoding.decode_tokens_bytes(ids)
    ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
    spans = np.stack([np.append(0, ends)[:-1], ends], axis=1)
    return ids, spans, [piece.decode("utf-8", errors="replace") for piece in pieces] if shown else []


def _byte_spans(text: str, offsets: list[tuple[int, int]]) -> np.ndarray:
    """Character offsets as byte offsets; in ASCII text they are the same."""
    spans = np.array(offsets, np.int64).reshape(-1, 2)
    if text.isascii():
        return spans
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    # Every byte but the later ones of a character begins one.
    return np.append(np.flatnonzero(raw & 0xC0 != 0x80), len(raw))[spans]


def tokenizer_from_file(spark: SparkSession, path: str) -> Tokenizer:
    """A ``tokenizer.json`` at a path the driver can read; its name is the file stem."""
    with open(path, encoding="utf-8") as handle:
        return tokenizer_from_json(spark, handle.read(), PurePosixPath(path).stem)


def tokenizer_from_json(spark: SparkSession, definition: str, name: str) -> Tokenizer:
    return Tokenizer(name, HUGGINGFACE, spark.sparkContext.broadcast(definition))


def tokenizer_from_hub(spark: SparkSession, model: str) -> Tokenizer:
    """A published tokenizer by model name; needs network access on the driver."""
    import tokenizers

    definition = tokenizers.Tokenizer.from_pretrained(model).to_str()
    return tokenizer_from_json(spark, definition, model)


def tokenizer_from_tiktoken(spark: SparkSession, encoding: str = "cl100k_base") -> Tokenizer:
    """A named encoding; its ranks come from tiktoken's cache or, failing that, the network."""
    import tiktoken

    chosen = parse_encoding(encoding)
    if chosen is None:
        raise ValueError(f"unknown encoding {encoding!r}")
    loaded = tiktoken.get_encoding(chosen)
    return tokenizer_from_ranks(
        spark, chosen, loaded._mergeable_ranks, loaded._pat_str, loaded._special_tokens
    )


def tokenizer_from_ranks(
    spark: SparkSession,
    name: str,
    ranks: dict[bytes, int],
    pattern: str,
    special_tokens: dict[str, int],
) -> Tokenizer:
    parts = {
        "name": name,
        "pat_str": pattern,
        "mergeable_ranks": ranks,
        "special_tokens": special_tokens,
    }
    return Tokenizer(f"tiktoken/{name}", TIKTOKEN, spark.sparkContext.broadcast(parts))


def choose_tokenizer(
    spark: SparkSession,
    backend: str = TIKTOKEN,
    encoding: str = "cl100k_base",
    path: str | None = None,
    model: str | None = None,
) -> Tokenizer:
    """The tokenizer the user asked for; a local file has priority over any name."""
    if path:
        return tokenizer_from_file(spark, path)
    chosen = parse_backend(backend)
    if chosen == TIKTOKEN:
        return tokenizer_from_tiktoken(spark, encoding)
    if chosen == GPT2:
        return tokenizer_from_hub(spark, "gpt2")
    if chosen == HUGGINGFACE and model:
        return tokenizer_from_hub(spark, model)
    raise ValueError(f"no tokenizer for backend {backend!r}")


def token_pieces(raw: bytes, spans: list[tuple[int, int]]) -> list[dict]:
    """The text as token pieces and the gaps between them, in order.

    Tokens that end inside a character are joined with the next until the cut is clean.
    """
    pieces, last, open_at = [], 0, None
    for start, end in spans:
        if start > last:
            pieces.append({"is_token": False, "text": raw[last:start].decode("utf-8", "replace")})
        begin = start if open_at is None else open_at
        try:
            pieces.append({"is_token": True, "text": raw[begin:end].decode("utf-8")})
            open_at = None
        except UnicodeDecodeError:
            open_at = begin
        last = end
    tail = last if open_at is None else open_at
    if tail < len(raw):
        pieces.append({"is_token": False, "text": raw[tail:].decode("utf-8", "replace")})
    return pieces


_DETAIL = pa.struct(
    [
        ("token_id", pa.int32()),
        ("byte_start", pa.int32()),
        ("byte_end", pa.int32()),
        ("text", pa.string()),
    ]
)
_SPAN = pa.struct([("byte_start", pa.int32()), ("byte_end", pa.int32())])
_PIECE = pa.struct([("is_token", pa.bool_()), ("text", pa.string())])


def _lists(ids: list[list[int]], values: pa.Array) -> pa.Array:
    """Flat values of tokens as one list per text."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    bounds = np.append(0, np.cumsum(sizes)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), values)


def _flat(parts: Iterable, kind: pa.DataType) -> pa.Array:
    return pa.array(list(chain.from_iterable(parts)), kind)


def _bounds(found: list[tuple]) -> list[pa.Array]:
    spans = np.concatenate([np.zeros((0, 2), np.int64), *[f[1] for f in found]]).astype(np.int32)
    return [pa.array(np.ascontiguousarray(spans[:, side])) for side in (0, 1)]


def _counts(texts: list[str], ids: list[list[int]]) -> pa.Array:
    return pa.array([len(found) for found in ids], pa.int32())


def _ids(texts: list[str], ids: list[list[int]]) -> pa.Array:
    return _lists(ids, _flat(ids, pa.int32()))


def _details(texts: list[str], found: list[tuple]) -> pa.Array:
    ids = [f[0] for f in found]
    shown = _flat((f[2] for f in found), pa.string())
    values = [_flat(ids, pa.int32()), *_bounds(found), shown]
    return _lists(ids, pa.StructArray.from_arrays(values, fields=list(_DETAIL)))


def _spans(texts: list[str], found: list[tuple]) -> pa.Array:
    return _lists([f[0] for f in found], pa.StructArray.from_arrays(_bounds(found), fields=list(_SPAN)))


def _segments(texts: list[str], found: list[tuple]) -> pa.Array:
    cut = [token_pieces(t.encode("utf-8"), f[1].tolist()) for t, f in zip(texts, found, strict=True)]
    return pa.array(cut, pa.list_(_PIECE))


def _token_udf(make_encoder: Callable[[], Callable], shape: Callable, sql_type: str):
    """A column function: ``shape`` makes an array of texts and what the encoder found in them."""

    def encode_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = make_encoder()
        for batch in batches:
            for run in runs(batch, ENCODED_BYTES):
                present = run.drop_null().to_pylist()
                shaped = shape(present, encode(present))
                if run.null_count:
                    place = np.cumsum(np.asarray(run.is_valid())) - 1
                    shaped = shaped.take(pa.array(place, mask=np.asarray(run.is_null())))
                yield shaped

    return F.arrow_udf(encode_batches, sql_type).asNondeterministic()


def count_tokens_udf(tokenizer: Tokenizer):
    return _token_udf(tokenizer.ids, _counts, "int")


def token_ids_udf(tokenizer: Tokenizer):
    return _token_udf(tokenizer.ids, _ids, "array<int>")


def token_details_udf(tokenizer: Tokenizer):
    kind = "array<struct<token_id:int,byte_start:int,byte_end:int,text:string>>"
    return _token_udf(tokenizer.spans, _details, kind)


def _readable(text: Column) -> Column:
    return F.when(F.is_valid_utf8(text), text)


def count_tokens(text: Column, tokenizer: Tokenizer) -> Column:
    """Tokens per text, none added around it; text that cannot be read has none."""
    return F.coalesce(count_tokens_udf(tokenizer)(_readable(text)), F.lit(0))


def token_ids(text: Column, tokenizer: Tokenizer) -> Column:
    return token_ids_udf(tokenizer)(_readable(text))


def token_details(text: Column, tokenizer: Tokenizer) -> Column:
    """``array<struct<token_id, byte_start, byte_end, text>>``, offsets in UTF-8 bytes."""
    return token_details_udf(tokenizer)(_readable(text))


def token_offsets(text: Column, tokenizer: Tokenizer) -> Column:
    """``array<struct<byte_start, byte_end>>``."""
    kind = "array<struct<byte_start:int,byte_end:int>>"
    return _token_udf(partial(tokenizer.spans, False), _spans, kind)(_readable(text))


def token_segments(text: Column, tokenizer: Tokenizer) -> Column:
    """``array<struct<is_token, text>>``: token pieces and the gaps between them."""
    kind = "array<struct<is_token:boolean,text:string>>"
    return _token_udf(tokenizer.spans, _segments, kind)(_readable(text))
