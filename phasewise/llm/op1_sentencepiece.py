"""SentencePiece BPE encoding and decoding by a table of last tokens per prefix.

For every prefix of a word the encoding ends in exactly one token.  The table holds that
token for each prefix: an automaton over all pieces names the tokens that end at a place,
and the one that can stand behind the last token of the shorter prefix is stored.  Two
tokens can stand side by side if no merge across their border would come before the merges
that made them.  The ids are then read backwards through the table.  All words of a batch go
through the table together, place by place, in numpy.

Null and empty texts have no tokens and decode to the empty string.  Repeated rows and ties
of doc_id are encoded row by row.  Characters without a piece become byte tokens.  Only BPE
models with byte fallback, a dummy prefix and no normalisation are accepted.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from phasewise.llm.common import column, hold, portions, quoted, tidy

MARK = "▁"
#: Words remembered between portions of text in one worker.
REMEMBERED_WORDS = 250_000
#: Words longer than this are first cut where no piece has the two neighbouring characters.
LONG_WORD = 64
WORDS = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
NEVER = 1 << 30


class Pieces:
    """The tables of one model, built once in each worker."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as schema

        model = schema.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        trainer, rules = model.trainer_spec, model.normalizer_spec
        kinds = {p.type for p in model.pieces}
        if (trainer.model_type != 2 or not trainer.byte_fallback or kinds - {1, 2, 3, 6}
                or trainer.treat_whitespace_as_suffix or rules.precompiled_charsmap
                or not rules.add_dummy_prefix or rules.remove_extra_whitespaces):
            raise ValueError("only plain BPE models with byte fallback are supported")
        self.text = [p.piece for p in model.pieces]
        normal = [i for i, p in enumerate(model.pieces) if p.type == 1]
        self.id = {self.text[i]: i for i in normal}
        order = sorted({model.pieces[i].score for i in normal}, reverse=True)
        place = {score: k for k, score in enumerate(order)}
        self.rank = {self.text[i]: place[model.pieces[i].score] for i in normal}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.known = {t for t in self.id if len(t) == 1}
        self.joined = {t[k:k + 2] for t in self.id for k in range(len(t) - 1)}
        self.other = re.compile("[^" + "".join(map(re.escape, sorted(self.known))) + "]")
        self.silent = {i for i, p in enumerate(model.pieces) if p.type == 3}
        #: What an id stands for; bytes above 127 as lone surrogates until all are joined.
        self.surface = [
            trainer.unk_surface if p.type == 2
            else "" if p.type == 3
            else (b if b < 128 else 0xDC00 + b).to_bytes(4, "little").decode("utf-32-le", "surrogatepass")
            if p.type == 6 and (b := int(p.piece[3:5], 16)) >= 0
            else p.piece.replace(MARK, " ")
            for p in model.pieces
        ]
        self._splits()
        self._automaton()
        self.words: dict[str, tuple[int, ...]] = {}

    def merged(self, text: str) -> tuple[list[str], dict[str, tuple[str, str]]]:
        """Merge the best adjacent pair, leftmost first, until none is left; also the last split of each piece."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        made: dict[str, tuple[str, str]] = {}
        heap = [(r, k, parts[k], parts[k + 1]) for k in range(len(parts) - 1)
                if (r := self.rank.get(parts[k] + parts[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, left, right = heapq.heappop(heap)
            j = after[k]
            if parts[k] != left or j >= len(parts) or parts[j] != right:
                continue
            parts[k], parts[j] = left + right, None
            made[left + right] = (left, right)
            after[k] = after[j]
            if after[j] < len(parts):
                before[after[j]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b < len(parts) and (r := self.rank.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (r, a, parts[a], parts[b]))
        return [p for p in parts if p is not None], made

    def slow(self, word: str) -> list[int]:
        """Plain merging: for runs of marks, whose pieces tie, and characters without a piece."""
        ids: list[int] = []
        for part in re.split(f"({self.other.pattern})", word):
            if len(part) == 1 and part not in self.known:
                ids += [self.bytes[b] for b in part.encode("utf-8", "surrogatepass")]
            elif part:
                ids += [self.id[p] for p in self.merged(part)[0]]
        return ids

    def _splits(self) -> None:
        n = len(self.text)
        self.made_at = np.full(n, -1, np.int64)
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.usable: list[str] = []
        for text, i in self.id.items():
            if MARK * 2 in text:
                continue
            if len(text) > 1:
                parts, made = self.merged(text)
                if len(parts) > 1:
                    continue  # no text gives this piece
                a, b = made[text]
                if max(self.rank[x] if len(x) > 1 else -1 for x in (a, b)) >= self.rank[text]:
                    raise ValueError(f"the parts of piece {i} come after it")
                self.left[i], self.right[i], self.made_at[i] = self.id[a], self.id[b], self.rank[text]
            self.usable.append(text)
        width = np.int64(n)
        pairs: dict[int, int] = {}
        for text, rank in self.rank.items():
            for k in range(1, len(text)):
                a, b = self.id.get(text[:k]), self.id.get(text[k:])
                if a is not None and b is not None:
                    pairs[a * n + b] = rank
        self.width = width
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([pairs[k] for k in sorted(pairs)], np.int64)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self._slot(self.pair_keys)] = True
        self.memo_key = np.full(1 << 21, -1, np.int64)
        self.memo = np.zeros(1 << 21, bool)

    @staticmethod
    def _slot(keys: np.ndarray, bits: int = 22) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def _automaton(self) -> None:
        children: list[dict[int, int]] = [{}]
        token = [-1]
        for text in self.usable:
            at = 0
            for b in text.encode():
                if b not in children[at]:
                    children[at][b] = len(children)
                    children.append({})
                    token.append(-1)
                at = children[at][b]
            token[at] = self.id[text]
        step = np.zeros((len(children), 256), np.int32)
        fail = [0] * len(children)
        self.shorter = np.full(len(self.text), -1, np.int32)
        queue = [0]
        for at in queue:
            if at:
                step[at] = step[fail[at]]
            shorter = token[fail[at]] if at else -1
            if at and token[at] >= 0:
                self.shorter[token[at]] = shorter
            elif at:
                token[at] = shorter
            for b, child in children[at].items():
                fail[child] = int(step[at, b])
                step[at, b] = child
                queue.append(child)
        self.step, self.ends = step, np.array(token, np.int32)
        self.size = np.array([len(t.encode()) for t in self.text], np.int32)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether token b can follow token a; answers are remembered in a table of fixed size."""
        keys = a * self.width + b
        slots = self._slot(keys, 21)
        result = self.memo[slots]
        new = np.flatnonzero(self.memo_key[slots] != keys)
        if len(new):
            ask, at = np.unique(keys[new], return_inverse=True)
            found = self._walk(ask // self.width, ask % self.width)
            result[new] = found[at]
            slots = self._slot(ask, 21)
            # keys that share a slot: the last written key must go with its own answer
            self.memo_key[slots] = ask
            own = self.memo_key[slots] == ask
            self.memo[slots[own]] = found[own]
        return result

    def _walk(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undo the later of the two last merges at the border and look for a merge across it, step by step."""
        good = np.ones(len(a), bool)
        rows, x, y = np.arange(len(a)), a, b
        x_end, y_end = np.full(len(a), NEVER), np.full(len(a), NEVER)
        while len(rows):
            keys = x * self.width + y
            hit = np.flatnonzero(self.maybe[self._slot(keys)])
            bad = np.zeros(len(rows), bool)
            if len(hit):
                at = np.minimum(np.searchsorted(self.pair_keys, keys[hit]), len(self.pair_keys) - 1)
                rank = self.pair_rank[at]
                bad[hit] = (self.pair_keys[at] == keys[hit]) & (rank < x_end[hit]) & (rank <= y_end[hit])
            good[rows[bad]] = False
            x_at, y_at = self.made_at[x], self.made_at[y]
            go = ~bad & ((x_at >= 0) | (y_at >= 0))
            back = x_at > y_at
            x_end, y_end = np.where(back, x_at, x_end), np.where(back, y_end, y_at)
            x, y = np.where(back, self.right[x], x), np.where(back, y, self.left[y])
            rows, x, y, x_end, y_end = rows[go], x[go], y[go], x_end[go], y_end[go]
        return good

    def table(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of words that have only known characters and no run of marks."""
        raw = [w.encode() for w in words]
        length = np.array([len(r) for r in raw], np.int64)
        order = np.argsort(-length, kind="stable")
        length = length[order]
        data = np.frombuffer(b"".join(raw[k] for k in order), np.uint8)
        start = np.concatenate(([0], np.cumsum(length)[:-1]))
        last = np.full(len(data), -1, np.int64)
        state = np.zeros(len(words), np.int64)
        left = np.searchsorted(-length, -np.arange(length[0]), side="left")
        for i in range(int(length[0])):
            n = left[i]
            state = self.step[state[:n], data[start[:n] + i]].astype(np.int64)
            token = self.ends[state].astype(np.int64)
            rows = np.flatnonzero(token >= 0)
            token = token[rows]
            while len(rows):
                before = i - self.size[token]  # place where the shorter prefix ends
                first = before < 0
                previous = np.where(first, 0, last[start[rows] + np.maximum(before, 0)])
                fits = first.copy()
                ask = np.flatnonzero(~first & (previous >= 0))
                if len(ask):
                    fits[ask] = self.compatible(previous[ask], token[ask])
                done = rows[fits]
                last[start[done] + i] = token[fits]
                token = self.shorter[token[~fits]].astype(np.int64)
                rows = rows[~fits]
                rows, token = rows[token >= 0], token[token >= 0]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        rows, at = np.arange(len(words)), length.copy()
        counts = np.zeros(len(words), np.int64)
        while len(rows):
            token = last[start[rows] + at[rows] - 1]
            if (token < 0).any():
                raise AssertionError("a prefix has no last token")
            found.append((rows, token))
            counts[rows] += 1
            at[rows] -= self.size[token]
            rows = rows[at[rows] > 0]
        ends = np.cumsum(counts)
        flat = np.zeros(int(ends[-1]), np.int64)
        for k, (rows, token) in enumerate(found):
            flat[ends[rows] - 1 - k] = token
        ids, ends = flat.tolist(), ends.tolist()
        result: list[tuple[int, ...]] = [()] * len(words)
        low = 0
        for k, high in zip(order.tolist(), ends):
            result[k] = tuple(ids[low:high])
            low = high
        return result

    def cut(self, word: str) -> list[str]:
        """A long word cut between characters that no piece has side by side."""
        cuts = [k for k in range(1, len(word)) if word[k - 1:k + 1] not in self.joined]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])]

    def learn(self, words: set[str]) -> None:
        plain: dict[str, None] = {}
        long: dict[str, list[str]] = {}
        for w in words:
            if MARK * 2 in w or self.other.search(w):
                self.words[w] = tuple(self.slow(w))
            elif len(w) > LONG_WORD:
                long[w] = self.cut(w)
                plain.update(dict.fromkeys(long[w]))
            else:
                plain[w] = None
        if plain:
            found = list(plain)
            own = dict(zip(found, self.table(found)))
            self.words.update(own)
            for w, parts in long.items():
                self.words[w] = tuple(chain.from_iterable(own[p] for p in parts))

    def encode(self, texts: list[str]) -> list[list[int]]:
        split = [WORDS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(hold(self.words)) > REMEMBERED_WORDS:
            self.words.clear()
        self.learn(set(chain.from_iterable(split)) - self.words.keys())
        return [list(chain.from_iterable(map(self.words.__getitem__, ws))) for ws in split]

    def decode(self, ids: list[int]) -> str:
        """Text of the ids; the first mark goes, and bytes that are not UTF-8 become U+FFFD."""
        if not self.silent.isdisjoint(ids):  # bytes on both sides of a silent token are not one character
            cuts = [-1, *(k for k, i in enumerate(ids) if i in self.silent), len(ids)]
            text = "".join(self._joined(ids[a + 1:b]) for a, b in zip(cuts, cuts[1:]))
        else:
            text = self._joined(ids)
        first = next((i for i in ids if i not in self.silent), None)
        return text[1:] if first is not None and self.text[first].startswith(MARK) else text

    def _joined(self, ids: list[int]) -> str:
        text = "".join(map(self.surface.__getitem__, ids))
        if text.isascii():
            return text
        try:
            text.encode()
            return text
        except UnicodeEncodeError:
            return _valid(text.encode("utf-8", "surrogateescape"))


def _valid(data: bytes) -> str:
    """Decode; each byte outside a valid character becomes one U+FFFD."""
    parts: list[str] = []
    while True:
        try:
            parts.append(data.decode())
            return "".join(parts)
        except UnicodeDecodeError as e:
            parts += [data[:e.start].decode(), "�"]
            data = data[e.start + 1:]


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text",
           digests: bool = False) -> DataFrame:
    """One row per document: its id, ids (array) and decoded text, or counts and digests of them."""
    schema = f"{quoted(id_column)} {dict(docs.dtypes)[id_column]}, " + (
        "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        names = list(map(str, range(len(own.text))))
        for batch in batches:
            if not batch.num_rows:
                continue
            columns: list[list] = [[], [], []]
            for texts in portions(batch.column(1)):
                for ids in own.encode(texts):
                    text = own.decode(ids)
                    if digests:
                        joined = ",".join(map(names.__getitem__, ids))
                        columns[0].append(len(ids))
                        columns[1].append(hashlib.sha256(joined.encode()).hexdigest())
                        columns[2].append(hashlib.sha256(text.encode()).hexdigest())
                    else:
                        columns[0].append(ids)
                        columns[1].append(text)
            kinds = [pa.int64(), pa.string(), pa.string()] if digests else [pa.list_(pa.int32()), pa.string()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            fields = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[id_column, *fields])

    return docs.select(column(id_column), column(text_column).cast("string")).mapInArrow(tidy(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"), digests=True)
