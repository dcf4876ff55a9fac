"""Vector expressions and embedders.

Distances are exact: products and sums in double precision in the JVM.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_INSTRUCTION = "Instruct: Given a question or task about a codebase, retrieve relevant code snippets and their descriptions that fulfill the request\nQuery: "
#: Fixed values of known embedding models: prefix of a query, prefix of a passage, dimension.
MODELS: dict[str, tuple[str, str, int]] = {
    "intfloat/multilingual-e5-small": ("query: ", "passage: ", 384),
    "intfloat/multilingual-e5-base": ("query: ", "passage: ", 768),
    "intfloat/multilingual-e5-large": ("query: ", "passage: ", 1024),
    "BAAI/bge-small-en-v1.5": ("Represent this sentence for searching relevant passages: ", "", 384),
    "BAAI/bge-m3": ("", "", 1024),
    "jinaai/jina-embeddings-v2-base-code": ("", "", 768),
    "Qwen/Qwen3-Embedding-0.6B": (_INSTRUCTION, "", 1024),
    "Qwen/Qwen3-Embedding-4B": (_INSTRUCTION, "", 2560),
    "Qwen/Qwen3-Embedding-8B": (_INSTRUCTION, "", 4096),
}
HASH_MODEL, HASH_DIM = "hashed-words", 64
_WORD = re.compile(r"\w+")


class ModelNotCachedError(RuntimeError):
    """The model isn't on this machine, and nothing is downloaded unasked."""


def prefixes(model: str) -> tuple[str, str]:
    return MODELS.get(model, ("", "", 0))[:2]


def dimension(model: str, load: Callable | None = None) -> int:
    """A known model's dimension, or that of what another one makes of a word."""
    if model in MODELS:
        return MODELS[model][2]
    return HASH_DIM if model == HASH_MODEL else len((load or load_embedder)(model)(["a"])[0])


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """Distance of two unit vectors."""
    return F.lit(1.0) - dot(a, b)


def hashed_embedding(text: str, dim: int = HASH_DIM) -> np.ndarray:
    """Signed counts of a text's words by the md5 of each, as a unit vector: deterministic, and no model to load."""
    out = np.zeros(dim, np.float32)
    for word in _WORD.findall(text.lower()):
        h = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "big")
        out[h % dim] += 1 if h >> 63 else -1
    norm = float(np.linalg.norm(out))
    return out / norm if norm else out


def model_folder(model: str) -> str | None:
    """Where a model lies on this machine: a folder given as it is, or one below LODESTONE_MODELS, with a tokenizer and an ONNX graph."""
    for folder in (model, os.path.join(os.environ.get("LODESTONE_MODELS", ""), model)):
        if all(os.path.isfile(os.path.join(folder, f)) for f in ("tokenizer.json", "model.onnx")):
            return folder
    return None


def pooled(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Unit vectors: the mean of each text's token states, padding left out."""
    mean = (states * mask[..., None]).sum(1) / np.maximum(mask.sum(1, keepdims=True), 1)
    return mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)


@functools.cache
def _loaded(folder: str, batch: int = 64) -> Callable[[list[str]], list[np.ndarray]]:
    import onnxruntime
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(os.path.join(folder, "tokenizer.json"))
    tokenizer.enable_padding()
    if tokenizer.truncation is None:
        tokenizer.enable_truncation(512)
    session = onnxruntime.InferenceSession(os.path.join(folder, "model.onnx"), providers=["CPUExecutionProvider"])
    wanted = {x.name for x in session.get_inputs()}

    def encode(texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for at in range(0, len(texts), batch):
            coded = tokenizer.encode_batch(texts[at : at + batch])
            feed = {"input_ids": [x.ids for x in coded], "attention_mask": [x.attention_mask for x in coded], "token_type_ids": [x.type_ids for x in coded]}
            feed = {k: np.array(v, np.int64) for k, v in feed.items()}
            states = session.run(None, {k: v for k, v in feed.items() if k in wanted})[0]
            out += list(pooled(states, feed["attention_mask"]).astype(np.float32))
        return out

    return encode


def load_embedder(model: str = HASH_MODEL) -> Callable[[list[str]], list[np.ndarray]]:
    """A function from texts to unit vectors: the hashed model, or one in a local folder; nothing is downloaded.

    A loaded model stays for the life of the process.
    """
    if model == HASH_MODEL:
        return lambda texts: [hashed_embedding(t) for t in texts]
    folder = model_folder(model)
    if folder is None:
        raise ModelNotCachedError(model)
    return _loaded(folder)


def embed(df: DataFrame, text: str = "text", model: str = HASH_MODEL, out: str = "embedding", load: Callable = load_embedder) -> DataFrame:
    """``df`` with ``out``: the embedding of ``text`` with the model's passage prefix; the model is loaded once in a Python worker."""
    load(model)  # fails here, not on an executor, if there is no such model

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load(model)
        for part in parts:
            yield pd.Series(encode(part.fillna("").tolist()))

    return df.withColumn(out, run(F.concat(F.lit(prefixes(model)[1]), F.coalesce(text, F.lit("")))))
