"""Token ids of whole texts as the tokenizer's own library gives them."""

from __future__ import annotations

import json
import os
from array import array

from flowrisk.llm.common import worker_cache

#: The word pattern of byte-level tokenizers that split words by themselves (a fixed value of that format).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A run of so many characters of one kind goes to the library: the fast encoder is slow on it.
LONG_WORD = 5000


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes as: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def fast_encoder(kind: dict):
    """A rank-based encoder with the same ids, or None if the file is of a kind where they could differ.

    Equal results need: byte-level words, no other step, and every token either a byte or the result of one
    merge, numbered in the order of the merges. Then the pair that merges next is the one whose result has
    the lowest number, which is how the rank-based encoder picks it.
    """
    import tiktoken

    pre, model = kind.get("pre_tokenizer") or {}, kind.get("model") or {}
    if (pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space")
            or kind.get("normalizer") or kind.get("truncation") or kind.get("padding") or model.get("type") != "BPE"
            or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
            or any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in kind.get("added_tokens") or [])):
        return None
    letters, vocab = byte_letters(), model["vocab"]
    added = {x["content"]: x["id"] for x in kind.get("added_tokens") or []}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    order = [vocab[m] for m in merged]
    if order != sorted(set(order)) or set(vocab) - set(letters) - set(merged) - set(added):
        return None
    ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in added}
    return tiktoken.Encoding("file", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=added)


class Encoder:
    """Ids of texts by the file's library: sentencepiece for .model, tokenizers for .json.

    Byte-level .json files go through an encoder that gives the same ids several times faster; texts with
    very long words, and all other files, go through the library itself.
    """

    def __init__(self, path: str):
        self.fast = None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.library = lambda texts: model.encode(texts, num_threads=1)
            return
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self.library = lambda texts: [x.ids for x in whole.encode_batch_fast(texts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as file:
            self.fast = fast_encoder(json.load(file))
        self.special = list(self.fast.special_tokens_set) if self.fast else []

    def ids(self, text: str) -> list[int]:
        if not text:
            return []
        if self.fast is None or len(text) > LONG_WORD and max(map(len, text.split(" "))) > LONG_WORD \
                or " " * LONG_WORD in text:
            return self.library([text])[0]
        if any(s in text for s in self.special):
            return self.fast.encode(text, allowed_special="all", disallowed_special=())
        return self.fast.encode_ordinary(text)

    def packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        return array("I", self.ids(text)).tobytes()


def encoder(path: str) -> Encoder:
    """The worker's encoder for the file, made once."""
    cache = worker_cache()
    if path not in cache:
        cache[path] = Encoder(path)
    return cache[path]
