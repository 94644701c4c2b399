"""Fast, exact encoder for a lower-casing word BPE (``tokenizers`` JSON file).

White space always ends a word, so a text's ids are those of its
white-space-separated chunks in turn. Each distinct chunk is encoded once per
batch: chunks of plain letters, digits and signs go through one bulk call of a
byte-pair encoder that holds the same merges; every other chunk (apostrophes,
combining marks, other scripts) goes to the tokenizer itself. So do chunks that
hold the string of a special token: a plain call reads it as that token.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Code points whose lower case and composition never change a text's length.
_PLAIN = re.compile(r"[!-&(-~À-įĲ-ſ]*")
_ALL_PLAIN = re.compile(r"[\n!-&(-~À-įĲ-ſ]*")
_BODY, _LAST = 0x100, 0x200  # code points that stand for a byte within a word, and for its last byte


def _byte_of_char() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write bytes."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class WordBpe:
    """Encodes Arrow string arrays to token ids."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, self.special = whole["model"], [t["content"] for t in whole["added_tokens"]]
        if any(c.isspace() for t in self.special for c in t):
            raise ValueError("a special token with white space would lie across chunks")
        vocab, suffix, byte = model["vocab"], model["end_of_word_suffix"], _byte_of_char()

        def key(token: str) -> bytes:
            ends = token.endswith(suffix)
            codes = [_BODY + byte[c] for c in (token[: -len(suffix)] if ends else token)]
            if ends:
                codes[-1] += _LAST - _BODY
            return "".join(map(chr, codes)).encode()

        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        tokens = [c for c in byte] + [c + suffix for c in byte] + ["".join(m) for m in merges]
        ranks: dict[bytes, int] = {}
        ids = []
        for t in tokens:
            if ranks.setdefault(key(t), len(ids)) == len(ids):
                ids.append(vocab[t])
        self.ids = np.array(ids, dtype=np.uint32)
        self.ends = np.array([k.decode()[-1] >= chr(_LAST) for k in ranks], dtype=bool)
        self.fast = tiktoken.Encoding("words", pat_str=f"[{chr(_BODY)}-{chr(_LAST - 1)}]*[{chr(_LAST)}-{chr(_LAST + 255)}]", mergeable_ranks=ranks, special_tokens={})
        kinds = {"L": 1, "N": 2}
        self.kind = np.array([0 if chr(i).isspace() else kinds.get(unicodedata.category(chr(i))[0], 3) for i in range(0x180)], dtype=np.uint8)

    def _plain(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their number for each chunk."""
        if not chunks:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        text = "\n".join(chunks).lower() + "\n"
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kind = self.kind[chars]
        after = np.append(kind[1:], 0)
        ends = (kind != 0) & ((after != kind) | (kind == 2))
        wide = 1 + (chars >= 0x80)
        data = np.frombuffer(text.encode(), np.uint8).astype(np.uint16)
        last = np.zeros(len(data), bool)
        last[np.cumsum(wide)[ends] - 1] = True
        codes = (data + np.where(last, _LAST, _BODY).astype(np.uint16))[np.repeat(kind != 0, wide)]
        ranks = np.array(self.fast.encode_ordinary(codes.astype("<u2").tobytes().decode("utf-16-le")), dtype=np.int64)
        words = np.cumsum(ends)[kind == 0]  # up to the end of each chunk
        stop = np.append(0, np.flatnonzero(self.ends[ranks]) + 1)[words]
        return self.ids[ranks], np.diff(stop, prepend=0)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat uint32 ids of all texts and the number of ids of each; null is empty."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        # leading and trailing white space leaves empty chunks, which have no ids
        counts = np.asarray(pc.list_value_length(split)).astype(np.int64)
        words = pc.list_flatten(split).dictionary_encode()
        del split
        index, distinct = np.asarray(words.indices), words.dictionary.to_pylist()
        joined = "\n".join(distinct)
        special = [t for t in self.special if t in joined]
        if not special and _ALL_PLAIN.fullmatch(joined):
            flat, sizes = self._plain(distinct)
        else:
            is_plain = np.array([bool(_PLAIN.fullmatch(w)) and not any(t in w for t in special) for w in distinct], dtype=bool)
            flat, n = self._plain([w for w, p in zip(distinct, is_plain) if p])
            got = [e.ids for e in self.slow.encode_batch_fast([w for w, p in zip(distinct, is_plain) if not p], add_special_tokens=False)]
            flat = np.concatenate([flat, np.array([x for ids in got for x in ids], dtype=np.uint32)])
            order = np.argsort(~is_plain, kind="stable")
            sizes = np.concatenate([n, np.array([len(ids) for ids in got], dtype=np.int64)])
            begins = np.cumsum(sizes) - sizes
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            return self._spread(flat, begins[place], sizes[place], index, counts)
        return self._spread(flat, np.cumsum(sizes) - sizes, sizes, index, counts)

    @staticmethod
    def _spread(flat, begins, sizes, index, counts) -> tuple[np.ndarray, np.ndarray]:
        """From the ids of each distinct chunk to those of each text."""
        per_chunk = sizes[index].astype(np.int32)
        upto = np.append(0, np.cumsum(per_chunk, dtype=np.int64))
        ends = np.cumsum(counts)
        n = upto[ends] - upto[ends - counts]
        shift = begins[index] - upto[:-1]
        pos = np.repeat(shift.astype(np.int32), per_chunk)
        pos += np.arange(len(pos), dtype=np.int32)
        return flat[pos], n
