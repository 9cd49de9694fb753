"""Token ids of a byte-level BPE vocabulary.

Latin text is encoded from the vocabulary's merge ranks, which is several times as fast as the
library that the file is made for and gives the same ids; other text goes through that library.
"""

from __future__ import annotations

import functools
import json

import numpy as np

#: Fixed value: the pattern that byte-level BPE splits text with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _bytes_of_characters() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one printable character."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokens:
    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            saved = json.load(f)
        as_byte = _bytes_of_characters()
        special = {t["content"]: t["id"] for t in saved["added_tokens"]}
        ranks = {bytes(as_byte[c] for c in k): v for k, v in saved["model"]["vocab"].items() if k not in special}
        self.exact = Tokenizer.from_file(path)
        self.plain = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = tuple(special)
        # The merge ranks say the same only for plain byte-level BPE; any other file goes through its own library.
        before, model = saved.get("pre_tokenizer") or {}, saved["model"]
        self.ranked = (
            saved.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
            and model.get("type") == "BPE" and not model.get("ignore_merges") and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
        )
        #: By id: whether a sentence can end with this token.
        self.ends = np.zeros(max(max(ranks.values()), *special.values(), 0) + 1, bool)
        for k, v in ranks.items():
            self.ends[v] = k.rstrip(b"\"')]\n").endswith((b".", b"!", b"?")) or k.endswith(b"\n")

    def ids(self, text: str) -> np.ndarray:
        """As tokenizers encodes the text with add_special_tokens=False."""
        if self.ranked and not any(s in text for s in self.special) and _latin(text):
            return np.array(self.plain.encode_ordinary(text), np.uint32)
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


def _latin(text: str) -> bool:
    """Whether the libraries' character classes are sure to agree on every character."""
    try:
        return text.isascii() or len(text.encode("latin-1")) >= 0
    except UnicodeEncodeError:
        return max(text) < "ɐ"


@functools.lru_cache(maxsize=2)
def tokens(path: str) -> Tokens:
    return Tokens(path)
