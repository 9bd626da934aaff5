"""Static embedding models: WordPiece vocabulary, token vectors, mean pooling."""

from __future__ import annotations

import contextlib
import functools
import json
import os
import re
import unicodedata
import urllib.request
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def safetensors(path: str) -> dict[str, np.ndarray]:
    """The tensors of a safetensors file of types F32, F64 and I64."""
    kinds = {"F32": np.float32, "F64": np.float64, "I64": np.int64}
    with open(path, "rb") as f:
        data = f.read()
    size = int.from_bytes(data[:8], "little")
    out = {}
    for key, x in json.loads(data[8 : 8 + size]).items():
        if key == "__metadata__":
            continue
        if x["dtype"] not in kinds:
            raise ValueError(f"{key}: type {x['dtype']} isn't supported")
        a, b = x["data_offsets"]
        out[key] = np.frombuffer(data[8 + size + a : 8 + size + b], kinds[x["dtype"]]).reshape(x["shape"])
    return out


class WordPiece:
    def __init__(self, config: dict):
        model = config["model"]
        if model.get("type", "WordPiece") != "WordPiece":
            raise NotImplementedError(f"tokenizers of type {model['type']} aren't supported")
        self.vocabulary = model["vocab"]
        self.unknown = self.vocabulary[model.get("unk_token", "[UNK]")]
        self.prefix = model.get("continuing_subword_prefix", "##")
        self.longest = model.get("max_input_chars_per_word", 100)
        normal = config.get("normalizer") or {}
        self.lower = bool(normal.get("lowercase", True))
        self.strip = normal.get("strip_accents") if normal.get("strip_accents") is not None else self.lower

    def words(self, text: str) -> Iterator[str]:
        if self.strip:
            text = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
        if self.lower:
            text = text.lower()
        word = ""
        for c in text:
            kind = unicodedata.category(c)
            alone = kind[0] == "P" or (c.isascii() and not c.isalnum() and not c.isspace() and kind != "Cc") or 0x4E00 <= ord(c) <= 0x9FFF
            if c.isspace() or alone or kind in ("Cc", "Cf"):
                if word and (c.isspace() or alone):
                    yield word
                    word = ""
                if alone:
                    yield c
            else:
                word += c
        if word:
            yield word

    @functools.lru_cache(100_000)  # noqa: B019
    def pieces(self, word: str) -> tuple[int, ...]:
        """Longest pieces from the left; the unknown token if the word can't be made of pieces."""
        if len(word) > self.longest:
            return (self.unknown,)
        out, at = [], 0
        while at < len(word):
            for end in range(len(word), at, -1):
                piece = self.vocabulary.get((self.prefix if at else "") + word[at:end])
                if piece is not None:
                    break
            else:
                return (self.unknown,)
            out.append(piece)
            at = end
        return tuple(out)

    def encode(self, text: str, most: int = 512) -> list[int]:
        return [i for w in self.words(text) for i in self.pieces(w)][:most]


class Encoder:
    """Mean of the kept tokens' weighted vectors, of unit length if the model says so."""

    def __init__(self, folder: str):
        with open(os.path.join(folder, "tokenizer.json"), encoding="utf-8") as f:
            self.tokenizer = WordPiece(json.load(f))
        with open(os.path.join(folder, "config.json"), encoding="utf-8") as f:
            config = json.load(f)
        tensors = safetensors(os.path.join(folder, "model.safetensors"))
        self.vectors = tensors["embeddings"].astype(np.float32)
        self.weights, self.mapping = tensors.get("weights"), tensors.get("mapping")
        self.normal, self.most = bool(config.get("normalize", False)), int(config.get("max_length", 512))

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.vectors.shape[1]), np.float32)
        for i, text in enumerate(texts):
            ids = np.array(self.tokenizer.encode(text, self.most), np.int64)
            if len(ids):
                rows = self.vectors[self.mapping[ids] if self.mapping is not None else ids]
                out[i] = (rows * self.weights[ids][:, None] if self.weights is not None else rows).mean(axis=0)
        return out / (np.linalg.norm(out, axis=1, keepdims=True) + 1e-32) if self.normal else out


class HashEncoder:
    """Counts of hashed words; needs no model."""

    def __init__(self, size: int = 256):
        self.size = size

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size), np.float32)
        for i, text in enumerate(texts):
            for word in re.findall(r"\w+", text.lower()):
                out[i, zlib.crc32(word.encode()) % self.size] += 1
        return out


def embed(chunks: DataFrame, encoder, text: str = "content") -> DataFrame:
    """(chunk_id, embedding); encoder: a callable from texts to a matrix, broadcast to the executors."""
    shared = chunks.sparkSession.sparkContext.broadcast(encoder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"chunk_id": batch["chunk_id"], "embedding": list(shared.value(batch[text].fillna("").tolist()))})

    return chunks.select("chunk_id", F.col(text)).mapInPandas(run, "chunk_id long, embedding array<float>")


def load(folder: str | None = None) -> Encoder:
    """The model in the folder, else in the one named by SPARKSEEK_MODEL."""
    folder = folder or os.environ.get("SPARKSEEK_MODEL")
    if not folder or not os.path.isdir(folder):
        raise FileNotFoundError(f"no model folder: {folder}")
    return Encoder(folder)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "chunk_id long, embedding array<float>")


FILES = ("tokenizer.json", "model.safetensors", "config.json")


def download(base: str, folder: str) -> list[str]:
    """Fetches a model's files from under the URL `base`; returns those fetched. A file of the announced size is kept as it is."""
    os.makedirs(folder, exist_ok=True)
    fetched = []
    for name in FILES:
        target = os.path.join(folder, name)
        with urllib.request.urlopen(f"{base.rstrip('/')}/{name}", timeout=60) as source:
            size = source.headers.get("Content-Length")
            if size and os.path.isfile(target) and os.path.getsize(target) == int(size):
                continue
            part = f"{target}.part"
            try:
                with open(part, "wb") as f:
                    while block := source.read(1 << 20):
                        f.write(block)
                os.replace(part, target)
            except BaseException:
                with contextlib.suppress(FileNotFoundError):
                    os.remove(part)
                raise
        fetched.append(name)
    return fetched
