"""Encoding: one vocabulary with its split pattern, for single texts on the driver and for columns and DataFrames."""

from __future__ import annotations

import codecs
import hashlib
import os
from collections.abc import Collection, Iterable, Iterator, Mapping
from collections.abc import Set as AbstractSet
from pathlib import Path

import numpy as np
import regex

from .functions.bpe import Merger
from .operators import chat
from .registry import END, Spec, list_encoding_names, model_to_encoding, spec_of
from .sources import ranks as files

ALL = "all"


class Encoding:
    """get_encoding(name), or a vocabulary of one's own: Encoding(name, pat_str=, mergeable_ranks=, special_tokens=)."""

    def __init__(self, name: str, *, pat_str: str | None = None, mergeable_ranks: dict[bytes, int] | None = None, special_tokens: dict[str, int] | None = None, _spec: Spec | None = None):
        if _spec is None and (pat_str is None or mergeable_ranks is None):
            _spec = spec_of(name)
        self._spec, self.name = _spec, name
        self._pat_str = pat_str if pat_str is not None else _spec.pattern
        self._special_tokens = dict(special_tokens if special_tokens is not None else (_spec.specials if _spec else {}))
        self._ranks = mergeable_ranks
        self._cap = int(os.environ.get("LEXSPAN_MERGE_CACHE_SIZE", "100000"))
        self._merger: Merger | None = None
        self._decoder: dict[int, bytes] | None = None
        self._regex = None

    def __repr__(self) -> str:
        return f"<Encoding {self.name!r}>"

    # vocabulary
    @property
    def n_vocab(self) -> int:
        return self._spec.n_vocab if self._spec else max([*self._mergeable_ranks.values(), *self._special_tokens.values()], default=-1) + 1

    @property
    def max_token_value(self) -> int:
        return self.n_vocab - 1

    @property
    def eot_token(self) -> int:
        return self._special_tokens[END]

    @property
    def special_tokens_set(self) -> set[str]:
        return set(self._special_tokens)

    @property
    def _mergeable_ranks(self) -> dict[bytes, int]:
        return self.load_mergeable_ranks()

    def rank_file_path(self, *, cache_dir: str | Path | None = None) -> Path:
        return files.rank_file_path(self._spec.ranks if self._spec else self.name, cache_dir)

    ensure_rank_file = rank_file_path

    def load_mergeable_ranks(self, *, cache_dir: str | Path | None = None, force: bool = False) -> dict[bytes, int]:
        if self._ranks is None or (force and self._spec):
            payload = files.read_rank_file(self._spec.ranks, cache_dir)
            self._ranks = files.parse_blob(payload) if payload.startswith(files.MAGIC) else files.parse_ranks(payload)
            self._merger = self._decoder = None
        return self._ranks

    @property
    def key(self) -> str:
        """Names this vocabulary among those that workers hold."""
        h = hashlib.sha256(f"{self.name}\0{self._cap}".encode())
        for t, r in self._mergeable_ranks.items():
            h.update(b"%d %d " % (r, len(t)) + t)
        return h.hexdigest()

    @property
    def merger(self) -> Merger:
        if self._merger is None:
            self._merger = Merger(self._mergeable_ranks, self._cap)
        return self._merger

    @property
    def decoder(self) -> dict[int, bytes]:
        if self._decoder is None:
            self._decoder = {r: t for t, r in self._mergeable_ranks.items()} | {i: s.encode() for s, i in self._special_tokens.items()}
        return self._decoder

    def set_merge_cache_size(self, size: int) -> None:
        if size < 0:
            raise ValueError("the cache can't have a negative size")
        self._cap, self._merger = size, None

    def clear_merge_cache(self) -> None:
        self._merger = None

    def token_byte_values(self) -> list[bytes]:
        return sorted(self._mergeable_ranks)

    # policy
    def _allowed(self, allowed: str | AbstractSet[str]) -> set[str]:
        return self.special_tokens_set if allowed == ALL else set(allowed)

    def check_policy(self, text: str, allowed_special: str | AbstractSet[str] = frozenset(), disallowed_special: str | Collection[str] = ALL) -> set[str]:
        allowed = self._allowed(allowed_special)
        banned = (self.special_tokens_set if disallowed_special == ALL else set(disallowed_special)) - allowed
        for s in banned:
            if s and s in text:
                raise ValueError(f"the text holds the special token {s!r}; allow it, or take it out of disallowed_special")
        return allowed

    # encode
    def _pieces(self, text: str) -> list[bytes]:
        if self._regex is None:
            self._regex = regex.compile(self._pat_str)
        return [m[0].encode("utf-16", "surrogatepass").decode("utf-16", "replace").encode() for m in self._regex.finditer(text) if m[0]]

    def encode_ordinary(self, text: str) -> list[int]:
        return [i for p in self._pieces(text) for i in self.merger.piece(p)]

    def _segments(self, text: str, allowed: set[str]) -> Iterator[tuple[str, bool]]:
        if not allowed:
            yield text, False
            return
        at = 0
        for m in regex.finditer("|".join(map(regex.escape, sorted(allowed, key=len, reverse=True))), text):
            yield text[at : m.start()], False
            yield m[0], True
            at = m.end()
        yield text[at:], False

    def encode(self, text: str, *, allowed_special: str | AbstractSet[str] = frozenset(), disallowed_special: str | Collection[str] = ALL) -> list[int]:
        allowed = self.check_policy(text, allowed_special, disallowed_special)
        out: list[int] = []
        for part, special in self._segments(text, allowed):
            if special:
                out.append(self._special_tokens[part])
            else:
                out += self.encode_ordinary(part)
        return out

    def encode_generator(self, text: str, *, allowed_special: str | AbstractSet[str] = frozenset(), disallowed_special: str | Collection[str] = ALL) -> Iterator[list[int]]:
        """One list a piece; with allowed special tokens, one a segment and one a special token."""
        allowed = self.check_policy(text, allowed_special, disallowed_special)
        if not allowed:
            yield from (list(self.merger.piece(p)) for p in self._pieces(text))
            return
        for part, special in self._segments(text, allowed):
            if special:
                yield [self._special_tokens[part]]
            elif part:
                yield self.encode_ordinary(part)

    def encode_batch(self, text: Iterable[str], *, num_threads: int = 8, **policy) -> list[list[int]]:
        return [self.encode(t, **policy) for t in text]

    def encode_ordinary_batch(self, text: Iterable[str], *, num_threads: int = 8) -> list[list[int]]:
        return [self.encode_ordinary(t) for t in text]

    def encode_gpu(self, texts: Iterable[str], *, device: str = "auto", chunk_bytes: int = 16384, overlap_bytes: int = 512, strict_verify: bool = True, num_threads: int = 1, **policy) -> list[list[int]]:
        """Exact encoding of each text; there is no device to choose here, and the arguments are only checked."""
        if device not in ("auto", "metal"):
            raise ValueError(f"unknown device {device!r}")
        if chunk_bytes <= 0 or overlap_bytes < 0:
            raise ValueError("chunk_bytes must be positive, and overlap_bytes not negative")
        return [self.encode(t, **policy) for t in texts]

    def count_gpu(self, texts: Iterable[str], **options) -> list[int]:
        return [len(x) for x in self.encode_gpu(texts, **options)]

    def encode_to_numpy(self, text: str, **policy) -> np.ndarray:
        return np.array(self.encode(text, **policy), np.uint32)

    def encode_single_token(self, text_or_bytes: str | bytes) -> int:
        if isinstance(text_or_bytes, str):
            if text_or_bytes in self._special_tokens:
                return self._special_tokens[text_or_bytes]
            text_or_bytes = text_or_bytes.encode()
        return self._mergeable_ranks[text_or_bytes]

    def encode_raw_bytes(self, data: bytes) -> list[int]:
        """The whole input as one piece, without the split pattern."""
        return list(self.merger.piece(data)) if data else []

    def encode_file_native(self, path: str | Path) -> list[int]:
        return self.encode_raw_bytes(Path(path).read_bytes())

    def count_file_native(self, path: str | Path) -> int:
        return len(self.encode_file_native(path))

    def is_file_within_token_limit_native(self, path: str | Path, token_limit: int) -> int | bool:
        return self._within(self.count_file_native(path), token_limit)

    def encode_file_path(self, path: str | Path, **policy) -> list[int]:
        """A whole file as text, split by the pattern."""
        return self.encode(Path(path).read_bytes().decode("utf-8", "replace"), **policy)

    def count_file_path(self, path: str | Path, **policy) -> int:
        return len(self.encode_file_path(path, **policy))

    def is_file_path_within_token_limit(self, path: str | Path, token_limit: int, **policy) -> int | bool:
        return self.is_within_token_limit(Path(path).read_bytes().decode("utf-8", "replace"), token_limit, **policy)

    # count
    def count(self, text: str, **policy) -> int:
        return len(self.encode(text, **policy))

    count_tokens = count

    def count_batch(self, texts: Iterable[str], *, num_threads: int = 8) -> list[int]:
        return [self.count(t) for t in texts]

    @staticmethod
    def _within(n: int, limit: int) -> int | bool:
        if limit < 0:
            raise ValueError("a token limit can't be negative")
        return n if n <= limit else False

    def is_within_token_limit(self, text: str, token_limit: int, **policy) -> int | bool:
        if token_limit < 0:
            raise ValueError("a token limit can't be negative")
        n = 0
        for ids in self.encode_generator(text, **policy):
            n += len(ids)
            if n > token_limit:
                return False
        return n

    # decode
    def decode_bytes(self, tokens: Iterable[int]) -> bytes:
        try:
            return b"".join(self.decoder[t] for t in tokens)
        except KeyError as e:
            raise ValueError(f"no token has the id {e.args[0]}") from None

    def decode(self, tokens: Iterable[int], errors: str = "replace") -> str:
        return self.decode_bytes(tokens).decode("utf-8", errors)

    def decode_single_token_bytes(self, token: int) -> bytes:
        return self.decoder[token]

    def decode_tokens_bytes(self, tokens: Iterable[int]) -> list[bytes]:
        return [self.decode_single_token_bytes(t) for t in tokens]

    def decode_with_offsets(self, tokens: Iterable[int]) -> tuple[str, list[int]]:
        offsets, n, parts = [], 0, self.decode_tokens_bytes(tokens)
        for p in parts:
            offsets.append(max(0, n - (bool(p) and p[0] & 0xC0 == 0x80)))
            n += sum(c & 0xC0 != 0x80 for c in p)
        return b"".join(parts).decode("utf-8", "strict"), offsets

    def decode_generator(self, tokens: Iterable[int], *, errors: str = "replace") -> Iterator[str]:
        d = codecs.getincrementaldecoder("utf-8")(errors)
        for t in tokens:
            if s := d.decode(self.decode_bytes([t])):
                yield s
        if s := d.decode(b"", True):
            yield s

    def decode_batch(self, batch: Iterable[Iterable[int]], *, num_threads: int = 8) -> list[str]:
        return [self.decode(t) for t in batch]

    # chat
    def _chat(self, messages: Iterable[Mapping], prime: str | None, template, policy: dict) -> Iterator[list[int]]:
        config = chat.resolve_template(template)
        allowed = self._allowed(policy.get("allowed_special", frozenset())) | chat.implied_specials(config, self._special_tokens)
        for s in chat.segments(messages, config, prime):
            yield self.encode(s, allowed_special=allowed, disallowed_special=policy.get("disallowed_special", ALL))

    def encode_chat_generator(self, messages: Iterable[Mapping], *, prime_with_assistant_response: str | None = "assistant", template=chat.DEFAULT, **policy) -> Iterator[list[int]]:
        return self._chat(messages, prime_with_assistant_response, template, policy)

    def encode_chat(self, messages: Iterable[Mapping], **options) -> list[int]:
        return [i for x in self.encode_chat_generator(messages, **options) for i in x]

    def count_chat(self, messages: Iterable[Mapping], **options) -> int:
        return sum(len(x) for x in self.encode_chat_generator(messages, **options))

    count_chat_tokens = count_chat

    def is_chat_within_token_limit(self, messages: Iterable[Mapping], token_limit: int, **options) -> int | bool:
        if token_limit < 0:
            raise ValueError("a token limit can't be negative")
        n = 0
        for x in self.encode_chat_generator(messages, **options):
            n += len(x)
            if n > token_limit:
                return False
        return n


def get_encoding(name: str) -> Encoding:
    return Encoding(name, _spec=spec_of(name))


def encoding_for_model(model: str) -> Encoding:
    return get_encoding(model_to_encoding(model))


__all__ = ["Encoding", "encoding_for_model", "get_encoding", "list_encoding_names"]
