"""Token ids of whole texts by a public byte-level vocabulary, inside tasks."""

from __future__ import annotations

import base64
import re
from pathlib import Path

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Texts with characters beyond these go through the tokenizers library, so that libraries' classes of rare characters can't differ.
_RARE = "[^\x00-\x1b\x20-ɏ‐-‧]"
_ENCODERS: dict[tuple[str, bool], "Encoder"] = {}


class Encoder:
    """Ids that the tokenizers library gives for a vocabulary file.

    A ``.tiktoken`` file of the same name holds the same vocabulary as ranks; where it
    is there, common texts are encoded from it, which gives the same ids four times
    as fast.  The string of a special token in a text is that token, as the library has it;
    with ``spelled`` it is ordinary text.
    """

    def __init__(self, path: str, spelled: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = spelled
        added = [] if spelled else [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.slow = re.compile("|".join([_RARE, *added]))
        ranks = Path(path).with_suffix(".tiktoken")
        self.fast = None
        if ranks.exists():
            import public_tokenizers

            with ranks.open("rb") as lines:
                table = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding(ranks.stem, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str | None) -> np.ndarray:
        """The ids as little-endian unsigned 32-bit integers; null: none."""
        if not text:
            return np.zeros(0, dtype="<u4")
        if self.fast is None or self.slow.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.asarray(self.fast.encode_to_numpy(text), dtype="<u4")


def encoder(path: str, spelled: bool = False) -> Encoder:
    """The encoder of this process for a vocabulary file."""
    if (path, spelled) not in _ENCODERS:
        _ENCODERS[path, spelled] = Encoder(path, spelled)
    return _ENCODERS[path, spelled]


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))
