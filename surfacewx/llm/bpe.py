"""Byte-level BPE encoding by a prefix-sharing trie, and decoding.

In BPE the encoding of a text's prefix is fixed by its last token: token
``t`` ends the encoding of a prefix exactly if it is a suffix of it and the
merges leave ``t`` and the last token before ``t`` apart. So distinct words go
into a trie, and one depth-first walk gives each node the last token of its
prefix from those of its ancestors: a prefix that many words share is encoded
once. A word's tokens are read backwards from its node.

Words are those of the vocabulary file's byte-level splitting; strings of
added tokens are cut out of a text first, as the tokenizers library does.
Only a bounded cache of words outlives a batch.
"""

from __future__ import annotations

import gc
import json
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surfacewx.llm.common import fresh, mapped, quoted, slices

#: Words held between slices, by number and by characters: long words fill memory sooner.
CACHED_WORDS, CACHED_CHARS = 500_000, 8 << 20
CACHED_PAIRS = 1_000_000
_TAIL = 4
_NEVER = 1 << 60
_BYTE = (-1, -1, -1)  # no merge makes a byte
_PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]

# Fixed value: the pattern of byte-level BPE, \s written as the Unicode property it stands for.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable
    Latin-1 stands for itself, the rest for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A vocabulary with merges, and the words encoded so far."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model = data["model"]
        if model["type"] != "BPE" or (data.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or data.get("normalizer"):
            raise ValueError("only byte-level BPE without a normalizer")
        letters = byte_letters()
        as_bytes = {s: bytes(letters[c] for c in s) for s in model["vocab"]}
        self.id_of = {as_bytes[s]: i for s, i in model["vocab"].items()}
        added = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        top = max([*model["vocab"].values(), *added.values()])
        self.bytes_of = [b""] * (top + 1)
        for b, i in self.id_of.items():
            self.bytes_of[i] = b
        for s, i in added.items():
            self.bytes_of[i] = s.encode()
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = {}
        for rank, (a, b) in enumerate(merges):
            self.merges[model["vocab"][a], model["vocab"][b]] = (rank, model["vocab"][a + b])
        #: Token to the rank and the parts of the merge that makes it.
        self.made = {t: (rank, *parts) for parts, (rank, t) in self.merges.items()}
        if len(self.made) != len(self.merges):
            raise ValueError("several merges make the same token")
        #: Only tokens that are the encoding of their own bytes can be in an encoding.
        for t, (rank, a, b) in sorted(self.made.items(), key=lambda x: x[1][0]):
            if not (self.bytes_of[a] in self.id_of and self.bytes_of[b] in self.id_of and self._meet_apart(a, b, rank)):
                self.id_of.pop(self.bytes_of[t], None)
        #: The last four bytes, or fewer, to the sizes of tokens that can end so, long ones first:
        #: for four bytes of all tokens, for fewer of those that are no longer.
        sizes: dict[bytes, set] = {}
        for b in self.id_of:
            sizes.setdefault(b[-_TAIL:], set()).add(len(b))
        for b in sorted(sizes, key=len):
            sizes[b] |= set().union(*(sizes.get(b[k:], ()) for k in range(1, len(b))))
        self.sizes = {b: tuple(sorted(x, reverse=True)) for b, x in sizes.items()}
        self.words: dict[str, bytes] = {}
        self.held = 0  # characters of the words held
        self.apart: dict[tuple[int, int], bool] = {}
        self.special = {s: np.array([i], "<u4").tobytes() for s, i in added.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.split = regex.compile(SPLIT)

    def _meet_apart(self, a: int, b: int, until: int) -> bool:
        """Whether no merge joins ``a`` and ``b``, or parts of them that touch,
        before time (rank) ``until``.

        Goes back in time over the merges that build both: ``x`` is the part of
        ``a`` and ``y`` that of ``b`` which touch. They would merge if their
        pair's rank comes before the merge that next takes ``x`` (the earlier
        place wins a tie) or ``y`` away.
        """
        x, y, x_goes, y_goes = a, b, until, until
        rank_of, made = self.merges, self.made
        while True:
            pair = rank_of.get((x, y))
            if pair is not None and pair[0] < x_goes and (pair[0] < y_goes or pair[0] == y_goes < until):
                return False
            x_made, y_made = made.get(x, _BYTE), made.get(y, _BYTE)
            if x_made[0] > y_made[0]:
                x_goes, _, x = x_made
            elif y_made is not _BYTE:
                y_goes, y, _ = y_made
            else:
                return True

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether ``a, b`` is the encoding of the bytes of both together."""
        if len(self.apart) >= CACHED_PAIRS:
            self.apart.clear()
        known = self.apart[a, b] = self._meet_apart(a, b, _NEVER)
        return known

    def learn(self, words: list[str]) -> None:
        """Encode distinct words by a depth-first walk over their trie.

        The trie is held as its words in order, each inserted below the prefix
        that it shares with the word before; going through them in order is the
        depth-first walk. ``last`` has the last token of every prefix on the
        path from the root, and is cut back to the shared prefix at each word.
        """
        last: list[int] = []
        id_of, sizes, apart, out, bytes_of = self.id_of, self.sizes, self.apart, self.words, self.bytes_of
        before = b""
        for path, word in sorted([(w.encode(), w) for w in words]):
            size, depth = len(path), 0
            most = min(size, len(before))
            if path[:most] == before[:most]:
                depth = most
            else:
                while path[depth] == before[depth]:
                    depth += 1
            del last[depth:]
            before = path
            while depth < size:
                depth += 1
                tail = path[depth - _TAIL : depth] if depth > _TAIL else path[:depth]
                while (some := sizes.get(tail)) is None:
                    tail = tail[1:]
                for n in some:
                    if n > depth or (t := id_of.get(path[depth - n : depth])) is None:
                        continue
                    if n < depth:
                        known = apart.get((last[depth - n - 1], t))
                        if not (self.stay_apart(last[depth - n - 1], t) if known is None else known):
                            continue
                    last.append(t)
                    break
            ends = []
            while depth:
                ends.append(last[depth - 1])
                depth -= len(bytes_of[ends[-1]])
            ends.reverse()
            out[word] = _PACK[len(ends)](*ends) if len(ends) < len(_PACK) else np.array(ends, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split, parts = self.split.findall, []
        for text in texts:
            if any(map(text.__contains__, self.special)):
                row: list[str] = []
                for i, piece in enumerate(self.cut.split(text)):
                    row += [piece] if i % 2 else split(piece)
                parts.append(row)
            else:
                parts.append(split(text))
        if len(self.words) > CACHED_WORDS or self.held > CACHED_CHARS:
            self.words.clear()
            self.held = 0
        self.words.update(self.special)
        new = list(set().union(*parts).difference(self.words))
        self.held += sum(map(len, new))
        collecting = gc.isenabled()
        gc.disable()  # a trie has no cycles, and looking for them takes longer than the walk
        try:
            self.learn(new)
        finally:
            if collecting:
                gc.enable()
        known = self.words.__getitem__
        return [b"".join(map(known, row)) for row in parts]

    def decode(self, ids: bytes) -> str:
        """The text of ids (added tokens included); bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(2)
def _vocabulary(spec: str) -> Vocabulary:
    return Vocabulary(spec)


def encode_decode(df: DataFrame, vocabulary_path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all but the text and those named like the new ones) with ``n_tokens`` (long),
    ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded`` (the ids
    decoded again, special tokens included).

    The driver reads the vocabulary (a few MB, fixed) and broadcasts it. Null
    texts count as empty: no ids, empty ``decoded``. Rows keep their number; an
    empty table gives an empty result. Texts of any length are encoded whole, and
    a text is one task's work. Which columns are named like the new ones is the
    session's choice (``N_TOKENS`` is, unless it is case-sensitive).
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        sent = df.sparkSession.sparkContext.broadcast(f.read())
    keep = df.drop(text_col, "n_tokens", "ids", "decoded").columns if keep is None else keep
    new = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(sent.value)
        for b in slices(batches):
            ids = vocabulary.encode([t or "" for t in b.column(b.num_columns - 1).to_pylist()])
            made = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([vocabulary.decode(x) for x in ids], pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], names=[*keep, "n_tokens", "ids", "decoded"])

    source = df.select(*map(quoted, keep), F.col(text_col).alias(fresh(df, "_bpe_text")))
    return mapped(source, run, T.StructType([*source.schema.fields[:-1], *new]))
