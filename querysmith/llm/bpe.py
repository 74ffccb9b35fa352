"""Exact byte-pair encoding by one pass over each prefix, and decoding.

Of every prefix of a piece the encoding has one last token, and a token can be it only if the encoding of what is before ends with a
token that the two don't merge across. So a table over prefixes holds the last token of each: tokens that end at a place come from
a suffix automaton of the vocabulary, the neighbour before from the table, and a test of the pair decides. Back-pointers (a place less
its token's length) then give the ids. Work is linear in the piece, whatever the order of the merges.

The pair test: both tokens are made by merges, in the order of the merge list. Seen backwards from the end, the token at each inner
edge is taken apart, the later merge first; if a merge of the two at the edge comes before they become parts of others, the tokens
don't stay side by side. Of equal merges the left one is done first.
"""

from __future__ import annotations

import json
import re
import sys
import types
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import fresh

#: Runs of characters that are kept with their ids by each process, and the characters that they may have in all.
KEPT, KEPT_CHARS = 1 << 18, 1 << 24

#: Characters of a text that are worked on at a time, and of rows that leave together.
BLOCK, PART = 1 << 20, 1 << 22

#: Slots for tested pairs.
_SLOTS = 1 << 20

#: Characters that all versions of Unicode from 12 on treat alike; runs with others go through the tokenizer's own normalizer.
_STABLE = re.compile("[\x21-\u0557\u1e00-\u1eff\u2010-\u2027\u2030-\u205e\u20a0-\u20bf\u2190-\u23ff\u2500-\u27bf\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fd5\uac00-\ud7a3]*")
_ASCII = re.compile("[!-~]*")

#: What Python takes for white space and the tokenizer's patterns don't.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_SPACE = re.compile(r"[ \t\n]")


class SuffixAutomaton:
    """The suffix automaton of several words: a state for each set of places at which the same pieces of them end."""

    def __init__(self, alphabet: int):
        self.alphabet, self.length, self.link, self.step = alphabet, [0], [-1], {}
        self._out: list[dict[int, int]] = [{}]

    def _new(self, length: int, link: int, out: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self._out.append(out)
        return len(self.length) - 1

    def _split(self, state: int, symbol: int, target: int) -> int:
        """The state of the pieces of `target` that are at most one longer than those of `state`, made if there is none."""
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._new(self.length[state] + 1, self.link[target], dict(self._out[target]))
        self.link[target] = copy
        while state >= 0 and self._out[state].get(symbol) == target:
            self._out[state][symbol] = copy
            state = self.link[state]
        return copy

    def add(self, word: list[int]) -> None:
        last = 0
        for symbol in word:
            known = self._out[last].get(symbol)
            if known is not None:
                last = self._split(last, symbol, known)
                continue
            new, state = self._new(self.length[last] + 1, 0, {}), last
            while state >= 0 and symbol not in self._out[state]:
                self._out[state][symbol] = new
                state = self.link[state]
            if state >= 0:
                self.link[new] = self._split(state, symbol, self._out[state][symbol])
            last = new

    def finish(self) -> SuffixAutomaton:
        """One table of steps for all states."""
        self.step = {state * self.alphabet + symbol: to for state, out in enumerate(self._out) for symbol, to in out.items()}
        del self._out
        return self

    def walk(self, word: list[int]) -> int:
        state = 0
        for symbol in word:
            state = self.step[state * self.alphabet + symbol]
        return state


class _Table:
    """Whole numbers by key, looked up for many keys at once."""

    def __init__(self, of: dict[int, int]):
        import numpy as np

        self.keys = np.fromiter(sorted(of), np.int64, len(of))
        self.values = np.fromiter((of[k] for k in self.keys.tolist()), np.int64, len(of))

    def get(self, keys):
        """Values, -1 where there is none."""
        import numpy as np

        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], -1)


class Vocabulary:
    """A tokenizers file with a byte-level BPE model, with or without marked word ends. Tokens are numbered by the time of their merge."""

    def __init__(self, path: str):
        import numpy as np
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, whole = spec["model"], Tokenizer.from_file(path)
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")) or spec.get("decoder"):
            raise ValueError(f"{path}: a plain BPE model without a decoder is needed")
        self.normalize = whole.normalizer.normalize_str if whole.normalizer else str
        self.split = whole.pre_tokenizer.pre_tokenize_str
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = _known_pattern(spec)
        end, vocab = model.get("end_of_word_suffix") or "", model["vocab"]
        # The byte alphabet of byte-level BPE: printable Latin-1 stands for itself, the rest for code points from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        code = [*plain, *(b for b in range(256) if b not in plain)]
        letters = [chr(b) for b in plain] + [chr(256 + i) for i in range(256 - len(plain))]
        self.byte = dict(zip(letters, code, strict=True))
        self.symbol = np.zeros(256, np.int64)
        self.symbol[code] = np.arange(256)
        self.end = len(letters) if end else 0
        base = letters + ([c + end for c in letters] if end else [])
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        names = base + [a + b for a, b in merges]
        place = {name: i for i, name in enumerate(names)}
        if len(place) < len(names) or any(max(place[a], place[b]) >= len(base) + i for i, (a, b) in enumerate(merges)) or any(n not in vocab for n in names):
            raise ValueError(f"{path}: merges must follow those of their parts, make a token each, and every byte must be a token")
        self.base, self.n = len(base), len(names)
        self.ids = np.array([vocab[n] for n in names], "<u4")
        self.text = {i: n for n, i in vocab.items()} | {i: t for t, i in self.special.items()}
        parts = [(i, i) for i in range(self.base)] + [(place[a], place[b]) for a, b in merges]
        self.left, self.right = np.array(parts, np.int64).T
        self.merged = _Table({a * self.n + b: self.base + i for i, (a, b) in enumerate(parts[self.base :])})
        spelled = [[i] for i in range(self.base)]
        for a, b in parts[self.base :]:
            spelled.append(spelled[a] + spelled[b])
        self.size = np.array([len(word) for word in spelled], np.int64)
        # Tokens whose own spelling is encoded otherwise never occur.
        new = np.arange(self.base, self.n)
        alone = [True] * self.base + self._apart(self.left[new], self.right[new], new).tolist()
        for token in new.tolist():
            alone[token] = alone[token] and alone[parts[token][0]] and alone[parts[token][1]]
        automaton = SuffixAutomaton(self.base)
        for word in spelled[self.base :]:
            automaton.add(word)
        automaton.finish()
        self.link, self.length, self.step = np.array(automaton.link), np.array(automaton.length), _Table(automaton.step)
        self._ending([automaton.walk(word) if ok and len(word) > 1 else 0 for word, ok in zip(spelled, alone, strict=True)])
        self.tested, self.apart_ = np.full(_SLOTS, -1, np.int64), np.zeros(_SLOTS, bool)
        self.runs: dict[str, bytes] = {}
        self.chars = 0

    def _ending(self, state: list[int]) -> None:
        """ending: for each state of the automaton the tokens that end there, longest first, filled up with -1."""
        import numpy as np

        own: dict[int, list[int]] = {}
        for token in sorted((t for t in range(self.n) if state[t]), key=lambda t: -self.size[t]):
            own.setdefault(state[token], []).append(token)
        every: list[list[int]] = [[]] * len(self.length)
        for at in np.argsort(self.length, kind="stable").tolist()[1:]:
            every[at] = own.get(at, []) + every[self.link[at]]
        self.ending = np.full((len(every), max(map(len, every)) + 1), -1, np.int64)
        for at, tokens in enumerate(every):
            self.ending[at, : len(tokens)] = tokens

    def _apart(self, left, right, but=-1):
        """Whether tokens side by side aren't merged across, a merge `but` aside; for many pairs."""
        import numpy as np

        out, pair = np.ones(len(left), bool), np.arange(len(left))
        left, right, but = left.copy(), right.copy(), np.broadcast_to(but, left.shape)
        until_left, until_right = np.full(len(left), self.n), np.full(len(left), self.n)
        while len(pair):
            merge = self.merged.get(left * self.n + right)
            across = (merge >= 0) & (merge != but) & (merge < until_left) & (merge <= until_right)
            out[pair[across]] = False
            rest = ~across & (np.maximum(left, right) >= self.base)
            pair, left, right, but, until_left, until_right = (x[rest] for x in (pair, left, right, but, until_left, until_right))
            later = left > right
            until_left, until_right = np.where(later, left, until_left), np.where(later, until_right, right)
            left, right = np.where(later, self.right[left], left), np.where(later, right, self.left[right])
        return out

    def apart(self, left, right):
        """As `_apart`, with the results of earlier tests kept in a table of fixed size."""
        import numpy as np

        key = left * self.n + right
        slot = (key * 0x9E3779B1 >> 7) % _SLOTS
        new = np.flatnonzero(self.tested[slot] != key)
        out = self.apart_[slot]
        if len(new):
            out[new] = self._apart(left[new], right[new])
            # Of pairs that share a slot one is written, key and result alike.
            order = np.unique(slot[new], return_index=True)[1]
            self.tested[slot[new][order]], self.apart_[slot[new][order]] = key[new][order], out[new][order]
        return out

    def last_tokens(self, symbols, offset, length):
        """The last token of every prefix of pieces; longest pieces first, piece p has the symbols from offset[p] on."""
        import numpy as np

        last = np.empty(len(symbols), np.int64)
        state, matched = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        alive = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right") if len(length) else []
        for i, n in enumerate(alive, 1):
            symbol, todo = symbols[offset[:n] + i - 1], np.arange(n)
            while len(todo):
                to = self.step.get(state[todo] * self.base + symbol[todo])
                hit = to >= 0
                state[todo[hit]] = to[hit]
                matched[todo[hit]] += 1
                todo = todo[~hit]
                root = state[todo] == 0
                matched[todo[root]] = 0
                todo = todo[~root]
                state[todo] = self.link[state[todo]]
                matched[todo] = self.length[state[todo]]
            found, todo, k = symbol, np.arange(n), 0
            while len(todo):
                token = self.ending[state[todo], k]
                todo, token = todo[token >= 0], token[token >= 0]
                before = i - self.size[token]
                fits = self.size[token] <= matched[todo]
                pair = np.flatnonzero(fits & (before > 0))
                fits[pair] = self.apart(last[offset[todo[pair]] + before[pair] - 1], token[pair])
                found[todo[fits]] = token[fits]
                todo, k = todo[~fits], k + 1
            last[offset[:n] + i - 1] = found
        return last

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces, each in one run over its prefixes and one back along the sizes of their last tokens."""
        import numpy as np

        if not pieces:
            return []
        order = sorted(range(len(pieces)), key=lambda p: -len(pieces[p]))
        length = np.array([len(pieces[p]) for p in order], np.int64)
        offset = np.cumsum(length) - length
        symbols = self.symbol[np.frombuffer(b"".join(pieces[p] for p in order), np.uint8)]
        symbols[offset + length - 1] += self.end
        last = self.last_tokens(symbols, offset, length)
        ends, at, rest = np.zeros(len(last), bool), offset + length - 1, length.copy()
        while len(at):
            ends[at] = True
            size = self.size[last[at]]
            rest = rest - size
            at, rest = (at - size)[rest > 0], rest[rest > 0]
        ids, to = self.ids[last[ends]].tobytes(), np.cumsum(ends)[offset + length - 1].tolist()
        out: list[bytes] = [b""] * len(pieces)
        for p, low, high in zip(order, [0, *to], to):
            out[p] = ids[4 * low : 4 * high]
        return out

    def pieces(self, run: str) -> list[bytes | int]:
        """Pieces of characters without white space between them; a number is a special token."""
        out: list[bytes | int] = []
        for part in self.marks.split(run) if self.marks else [run]:
            if part in self.special:
                out.append(self.special[part])
            elif self.pattern and _ASCII.fullmatch(part):
                out += [p.encode() for p in self.pattern.findall(part.lower())]
            elif self.pattern and _STABLE.fullmatch(part):
                # Lower case is by character, so a sigma at the end is one as any other.
                out += [p.encode() for p in self.pattern.findall(unicodedata.normalize("NFC", part).replace("\u03a3", "\u03c3").lower())]
            elif part:
                out += [bytes([self.byte[c] for c in p]) for p, _ in self.split(self.normalize(part))]
        return out

    def _learn(self, runs: set[str]) -> None:
        """Encodes runs together and keeps their ids."""
        import numpy as np

        split = {run: self.pieces(run) for run in runs}
        wanted = list({p for parts in split.values() for p in parts if isinstance(p, bytes)})
        known: dict[bytes | int, bytes] = {p: np.array([p], "<u4").tobytes() for p in self.special.values()}
        known.update(zip(wanted, self.encode_pieces(wanted), strict=True))
        self.runs.update((run, b"".join([known[p] for p in parts])) for run, parts in split.items())
        self.chars += sum(map(len, runs))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of texts, as little-endian unsigned 32-bit integers. No piece reaches over white space, so runs between it are encoded
        by themselves, new ones of a block together."""
        out: list[list[bytes]] = [[] for _ in texts]
        block: list[tuple[int, list[str]]] = []
        size = 0
        for i, text in enumerate(texts):
            for part in _blocks(text):
                block.append((i, _runs(part)))
                size += len(part)
                if size >= BLOCK:
                    self._encode(block, out)
                    block, size = [], 0
        self._encode(block, out)
        return [b"".join(ids) for ids in out]

    def _encode(self, block: list[tuple[int, list[str]]], out: list[list[bytes]]) -> None:
        if len(self.runs) > KEPT or self.chars > KEPT_CHARS:
            self.runs, self.chars = {}, 0
        known = self.runs
        if new := {run for _, runs in block for run in runs if run not in known}:
            self._learn(new)
        for i, runs in block:
            out[i].append(b"".join([known[run] for run in runs]))

    def decode(self, ids: bytes) -> str:
        """Tokens with a space between them, as a tokenizer without a decoder gives them. Unknown ids are left out."""
        import numpy as np

        text = self.text
        return " ".join([text[i] for i in np.frombuffer(ids, "<u4").tolist() if i in text])


def _known_pattern(spec: dict):
    """The pattern by which a file splits lower-cased, composed text; None if it does anything else."""
    import regex

    steps = [(s["type"], s.get("content"), s.get("pattern")) for s in (spec["normalizer"] or {}).get("normalizers", [])]
    cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    plain = [("NFC", None, None), ("Replace", " ", {"Regex": r"\s+"}), ("Lowercase", None, None)]
    if steps == plain and [c["type"] for c in cuts] == ["Split", "ByteLevel"] and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"] and not cuts[1]["use_regex"] and not cuts[1]["add_prefix_space"]:
        return regex.compile(cuts[0]["pattern"]["Regex"])
    return None


def _runs(text: str) -> list[str]:
    return re.findall(r"(?:[^\s]|[\x1c-\x1f])+", text) if _SEPARATORS.search(text) else text.split()


def _blocks(text: str):
    """A text in parts of about BLOCK characters, cut at white space; a part without any is longer."""
    at = 0
    while len(text) - at > 2 * BLOCK:
        cut = _SPACE.search(text, at + BLOCK)
        to = cut.end() if cut else len(text)
        yield text[at:to]
        at = to
    yield text[at:] if at else text


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, made once a process."""
    kept = sys.modules.setdefault("_querysmith_kept", types.ModuleType("_querysmith_kept")).__dict__
    if (key := f"bpe:{path}") not in kept:
        kept[key] = Vocabulary(path)
    return kept[key]


def _run(path: str, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)

        def coded(rows: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
            ids = vocab.encode(texts)
            own = {"ids": pa.array(ids, pa.binary()), "n_tokens": pa.array([len(i) // 4 for i in ids], pa.int64())}
            if decoded:
                own["decoded"] = pa.array([vocab.decode(i) for i in ids], pa.string())
            return pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.StructArray.from_arrays(list(own.values()), list(own))], rows.schema.names)

        for batch in batches:
            at, size, texts = 0, 0, []
            for i, text in enumerate(batch.column(batch.num_columns - 1), 1):
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size >= PART:  # so that a batch of long texts isn't held several times over
                    yield coded(batch.slice(at, i - at), texts)
                    at, size, texts = i, 0, []
            if texts:
                yield coded(batch.slice(at), texts)

    return run


def encode(docs: DataFrame, path: str, text_col: str = "text", out: str = "bpe", keep: list[str] | None = None, decoded: bool = False) -> DataFrame:
    """Adds a struct `out` to the columns `keep` (all): ids (binary, little-endian unsigned 32-bit) and n_tokens of whole texts, and with
    `decoded` what `decode` gives of the ids.

    The ids are those of the tokenizers library without special tokens of its own; the strings of special tokens inside a text are
    those tokens. A null text is empty. If a column is named like `out`, an underscore is put before ours. Repeated rows are encoded
    each; an empty table stays empty.
    """
    own, name = docs.columns if keep is None else keep, fresh(docs, out)
    rows = docs.select(*[F.col(f"`{c}`") for c in own], F.col(f"`{text_col}`").cast("string").alias(name))
    kinds = {"ids": BinaryType(), "n_tokens": LongType()} | ({"decoded": StringType()} if decoded else {})
    coded = StructField(name, StructType([StructField(*field) for field in kinds.items()]))
    return rows.mapInArrow(_run(path, decoded), StructType([*rows.schema.fields[:-1], coded]))


def decode(rows: DataFrame, path: str, ids: str = "bpe.ids", out: str = "decoded") -> DataFrame:
    """Adds the text `out` of ids: tokens as the vocabulary has them, joined by spaces. Null ids are none, ids it doesn't have are left out."""

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        vocab = vocabulary(path)
        return pd.Series([vocab.decode(bytes(i) if i is not None else b"") for i in column], dtype="object")

    return rows.withColumn(fresh(rows, out), run(F.col(ids)))
