"""Byte-level BPE over the tokenizers library, with a bounded cache of encoded words."""

from __future__ import annotations

import base64
import functools
import json
import os
import re
from collections.abc import Callable

import numpy as np
import public_tokenizers

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Entries of each of a worker's caches, and the longest text that goes into one. They bound memory only.
CACHE_ENTRIES, CACHE_CHARS = 80_000, 48
_INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")
_LATIN = re.compile(r"[\x00-\u024f]*\Z")
#: Fixed value: how the byte-level pre-tokenizer of the tokenizers library splits text by itself.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ODD_SPACE = re.compile(r" (?:\s|\Z)")
#: Patterns known to start a match at each single space between other characters (see words_of).
SPACE_FIRST = frozenset([BYTE_LEVEL_PATTERN, public_tokenizers.PATTERN])


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves; the others take code points from 256 on, in byte order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def parents(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that the merge of `token` joins: what its bytes come to by the lower ranks alone."""
    limit, parts = ranks[token], [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best, at = min(((ranks.get(a + b, limit), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(limit, 0))
        if best >= limit:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return tuple(parts)


@functools.lru_cache(4)
def rank_tokenizer_json(path: str, pattern: str) -> str:
    """A rank file as a definition for the tokenizers library: vocabulary, merges, and `pattern` as splitter."""
    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

    ranks, chars = read_ranks(path), byte_characters()
    show = lambda token: "".join(chars[b] for b in token)
    merges = [parents(t, ranks) for t in sorted(ranks, key=ranks.get) if len(t) > 1]
    made = Tokenizer(models.BPE({show(t): i for t, i in ranks.items()}, [(show(a), show(b)) for a, b in filter(None, merges)], ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    made.decoder = decoders.ByteLevel()
    return made.to_str()


def id_bytes(definition: str) -> list[bytes]:
    """The bytes behind each id of a definition; special tokens give their own text."""
    found = json.loads(definition)
    back = {c: b for b, c in enumerate(byte_characters())}
    special = {t["content"]: t["content"].encode() for t in found.get("added_tokens", [])}
    vocab = found["model"]["vocab"] | {t["content"]: t["id"] for t in found.get("added_tokens", [])}
    out = [b""] * (max(vocab.values(), default=-1) + 1)
    for token, i in vocab.items():
        out[i] = special.get(token) or bytes(back[c] for c in token)
    return out


def words_of(text: str) -> list[str]:
    """`text` cut before single spaces that stand between other characters.

    The patterns of SPACE_FIRST start a new match at such a space, whatever follows, so encoding the parts one by one
    gives the ids of the whole."""
    if _ODD_SPACE.search(text):
        first, *rest = _INNER_SPACE.split(text)
    else:
        first, *rest = text.split(" ")
    return [first, *[f" {x}" for x in rest]] if first else [f" {x}" for x in rest]


class Encoder:
    """Texts to ids as little-endian uint32 bytes.

    A text falls into words (words_of), whose ids are kept in two generations of a bounded cache; `backend`
    encodes those not met lately. With in_words unset it gets whole texts, as patterns that may match across a
    space need."""

    def __init__(self, backend: Callable[[str], bytes], in_words: bool = True):
        self._backend, self._known, self._older, self._in_words = backend, {}, {}, in_words

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self._in_words:
            return self._backend(text)
        words, known = words_of(text), self._known
        try:
            return b"".join([known[x] for x in words])
        except KeyError:
            pass
        if len(known) >= CACHE_ENTRIES:
            self._older, self._known = known, {}
            known = self._known
        long: dict[str, bytes] = {}
        for x in words:
            if x not in known and x not in long:
                ids = self._older.get(x)
                (known if len(x) <= CACHE_CHARS else long)[x] = self._backend(x) if ids is None else ids
        return b"".join([known[x] if x in known else long[x] for x in words])


def by_library(definition: str) -> Callable[[str], bytes]:
    """Words to ids by the tokenizers library.

    Matches of the pattern in Latin words go straight to its merges, as characters that stand for bytes;
    other words through the whole library, whose Unicode tables decide there."""
    import regex
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(definition)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    characters, known = dict(enumerate(byte_characters())), {}
    matches, merged = regex.compile(pattern_of(definition)).findall, tokenizer.model.tokenize

    def encode(word: str) -> bytes:
        if not _LATIN.match(word):
            return np.array(tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        out = []
        for part in matches(word):
            ids = known.get(part)
            if ids is None:
                ids = np.array([x.id for x in merged(part.encode().decode("latin-1").translate(characters))], "<u4").tobytes()
                if len(part) <= CACHE_CHARS:
                    if len(known) >= CACHE_ENTRIES:
                        known.clear()
                    known[part] = ids
            out.append(ids)
        return b"".join(out)

    return encode


@functools.lru_cache(2)
def rank_encoder(definition: str) -> Callable[[str | None], bytes]:
    """Texts to the ids of a definition, as its own library gives them without adding special tokens.

    Where the merges stand in the order of their ids, as those of ranks do, tiktoken gives the same ids several times as
    fast; others go by the library. So does any text in which one of the definition's added tokens occurs, since the
    library finds these in the text itself."""
    import tiktoken
    from tokenizers import Tokenizer

    found = json.loads(definition)
    vocab, added = found["model"]["vocab"], {t["content"] for t in found.get("added_tokens", [])}
    library = Tokenizer.from_str(definition)
    marks = re.compile("|".join(map(re.escape, sorted(added))), re.I) if added else None
    merged = [vocab["".join(x if isinstance(x, list) else x.split(" "))] for x in found["model"]["merges"]]
    back = {c: b for b, c in enumerate(byte_characters())}
    if merged != sorted(merged) or not set(back) <= set(vocab) or len(set(vocab) - added) != 256 + len(merged) or found.get("normalizer"):
        return lambda text: np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()
    ranks = {bytes(back[c] for c in token): i for token, i in vocab.items() if token not in added}
    plain = tiktoken.Encoding("own", pat_str=pattern_of(definition), mergeable_ranks=ranks, special_tokens={})

    def encode(text: str | None) -> bytes:
        if marks and text and marks.search(text):
            return np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(plain.encode_ordinary(text or ""), "<u4").tobytes()

    return encode


def pattern_of(definition: str) -> str:
    """The pattern by which a definition splits text before its merges."""
    steps = json.loads(definition)["pre_tokenizer"]
    split = [x["pattern"]["Regex"] for x in steps.get("pretokenizers", []) if x["type"] == "Split"]
    return split[0] if split else BYTE_LEVEL_PATTERN


@functools.lru_cache(2)
def encoder(definition: str) -> Encoder:
    """The worker's encoder for a definition, kept from task to task."""
    return Encoder(by_library(definition), pattern_of(definition) in SPACE_FIRST and not json.loads(definition).get("normalizer"))
