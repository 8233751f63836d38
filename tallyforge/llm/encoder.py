"""Token ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False)`` of the tokenizers library.

For tokenizers that lower-case, drop white space and split by one pattern (``splits_on_space``) a text is the sequence of its
chunks between white space. Chunks are split and told apart on Arrow buffers, and each distinct chunk of a slice is encoded once:
those of Latin letters, ASCII and plain marks in one call by the vocabulary's own merges (``Merges``), all others by the library.
Texts with the four control characters that Arrow, but not the tokenizer, takes for white space are encoded whole by the
library, as are all texts of other tokenizers. Nothing is kept between slices, so memory is bounded by a slice.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tallyforge.llm.rolling import pieces, release, text_buffer

SLICE = 1 << 22
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# marks and one-to-one lower-casing letters whose canonical composition is themselves; U+0130 becomes two characters in lower case
_PLAIN = r"!-~¡-©«-±´¶-¸»¿À-įı-ɏ‐-‧‰-⁞"
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ɏ]+|[0-9]|[^a-z0-9ß-öø-ɏ\n]+")
_ALL_PLAIN = re.compile(f"[{_PLAIN}\n]*")
_ONE_PLAIN = re.compile(f"[{_PLAIN}]*")
_END, _LINE = "\0", "\n"
# byte-level vocabularies show printable bytes as themselves and the others as the characters from 256 on
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_OF = {chr(b): b for b in _SHOWN} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class Merges:
    """The vocabulary as byte ranks for tiktoken: a word ends in a byte 0, which stands for the vocabulary's end-of-word mark.

    Ranks are ids; they give the library's merges where ids rise in the order of the merges (checked by ``of``).
    """

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.line = ranks[_LINE.encode()]  # never part of a word, so it can part chunks
        self.encoding = tiktoken.Encoding("words", pat_str=r"[^\x00\n]+\x00|\n", mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def of(cls, spec: dict) -> Merges | None:
        """Byte ranks of a tokenizer's specification, or None if they would not give its merges."""
        model = spec["model"]
        mark, vocab = model.get("end_of_word_suffix"), model["vocab"]
        plain = model.get("type") == "BPE" and mark and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        special = {t["content"] for t in spec.get("added_tokens", [])}
        if not plain:
            return None

        def raw(token: str) -> bytes:
            ended = token.endswith(mark) and len(token) > len(mark)
            return bytes(_BYTE_OF[c] for c in (token[:-len(mark)] if ended else token)) + (b"\0" if ended else b"")

        try:
            ranks = {raw(t): i for t, i in vocab.items() if t not in special}
            made = [ranks[raw(a) + raw(b)] for a, b in model["merges"]]
        except KeyError:
            return None
        last = max((ranks.get(bytes([b, 0]), len(vocab)) for b in range(1, 256)), default=0)
        rising = all(x < y for x, y in zip(made, made[1:], strict=False)) and made and last < made[0]
        return cls(ranks) if rising and len(ranks) == len(vocab) - len(special & vocab.keys()) else None

    def encode(self, lines: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks of ``lines`` (plain chunks, one per line, each closed by a line end), and the number of ids of each."""
        closed = _WORDS.sub("\\g<0>" + _END, lines.lower())
        ids = self.encoding.encode_to_numpy(closed, disallowed_special=())
        at = np.flatnonzero(ids == self.line)
        return ids[ids != self.line], np.diff(at, prepend=-1) - 1


class TextEncoder:
    """Ids of columns of texts by a tokenizer's file; ``width`` is the number of bytes that an id needs."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.width = 2 if self.size <= 1 << 16 else 4
        spec = json.loads(self.tokenizer.to_str())
        self.merges = Merges.of(spec) if splits_on_space(spec) else None

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.array([len(x) for x in got], np.int64)
        return np.fromiter((i for x in got for i in x), np.uint32, int(counts.sum())), counts

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks one after the other, and the number of ids of each."""
        if not len(chunks):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        kind = pa.list_(pa.string())
        joined = pc.binary_join(pa.array([chunks.cast(pa.string())], kind), _LINE)[0].as_py() + _LINE
        if _ALL_PLAIN.fullmatch(joined) and "<|" not in joined:
            return self.merges.encode(joined)
        lines = joined[:-1].split(_LINE)
        odd = np.array([_ONE_PLAIN.fullmatch(c) is None or "<|" in c for c in lines])
        ids, counts = self.merges.encode("".join(c + _LINE for c, o in zip(lines, odd, strict=True) if not o))
        more, their = self._whole([c for c, o in zip(lines, odd, strict=True) if o])
        all_counts, start = np.zeros(len(lines), np.int64), np.zeros(len(lines), np.int64)
        all_counts[~odd], all_counts[odd] = counts, their
        start[~odd] = np.cumsum(counts) - counts
        start[odd] = len(ids) + np.cumsum(their) - their
        return _gather(np.concatenate([ids, more]), start, all_counts), all_counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts (null: empty) one after the other, and the bounds of each text in them."""
        texts = texts.cast(pa.string()).fill_null("")
        if self.merges is None:
            ids, counts = self._whole(texts.to_pylist())
            return ids, np.append(0, np.cumsum(counts))
        odd = pc.match_substring_regex(texts, "[\\x1c-\\x1f]").to_numpy(zero_copy_only=False).astype(bool)
        split = pc.utf8_split_whitespace(pc.if_else(pa.array(odd), "", texts) if odd.any() else texts)
        chunks = split.flatten().dictionary_encode()
        ids, counts = self._chunks(chunks.dictionary)
        at = chunks.indices.to_numpy()
        start, own = (np.cumsum(counts) - counts)[at], counts[at]
        ids = _gather(ids, start, own)
        ends = np.cumsum(pc.list_value_length(split).to_numpy())
        bounds = np.append(0, np.append(0, np.cumsum(own))[ends])
        if not odd.any():
            return ids, bounds
        more, their = self._whole([t for t, o in zip(texts.to_pylist(), odd, strict=True) if o])
        total, start = np.diff(bounds), bounds[:-1].copy()
        total[odd], start[odd] = their, len(ids) + np.cumsum(their) - their
        return _gather(np.concatenate([ids, more]), start, total), np.append(0, np.cumsum(total))


def _gather(values: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The runs values[start[k]:start[k] + count[k]] one after the other."""
    total = int(count.sum())
    shift = start - (np.cumsum(count) - count)
    return values[np.arange(total) + np.repeat(shift, count)]


@functools.lru_cache(maxsize=1)
def encoder_of(path: str) -> TextEncoder:
    """The encoder of a file, built once per process."""
    return TextEncoder(path)


def splits_on_space(spec: dict) -> bool:
    """Whether texts can be cut at white space: the tokenizer lower-cases, drops white space and splits by its fixed pattern."""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    first = steps[0] if steps else {}
    kinds = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers") or []]
    plain = all(not (t["lstrip"] or t["rstrip"] or t["normalized"] or re.search(r"\s", t["content"]) or not t["content"].startswith("<|"))
                for t in spec.get("added_tokens", []))
    plain = plain and len(steps) == 2 and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
    return plain and first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert")) and \
        (first.get("pattern") or {}).get("Regex", "") == _PATTERN and kinds == ["NFC", "Replace", "Lowercase"]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``limit`` bytes of whole texts."""
    _, offsets = text_buffer(batch.column(column))
    for i, j, _, _ in pieces(np.zeros(0, np.uint8), offsets, limit):
        yield batch.slice(i, j - i)
    release()
