"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

The vocabulary file (tokenizers JSON: word-end BPE over a byte alphabet) is read once on the driver and broadcast;
its size is that of the merge list. A text is consumed as a stream of slices, a slice as a stream of pieces, each
piece as a stream of byte symbols. Rank-ordered merging is not left-to-right, but what follows a position can only change a bounded stretch
before it: `sufficient_lookahead` computes that bound from the merge list, and the transducer emits a token once
more symbols than the bound follow it. So a text is encoded in constant memory beside itself, as long as its white
space is not further apart than a slice; a longer stretch is normalised and its ids are held whole.

Null and empty texts give no tokens. Repeated rows are encoded alike. Empty tables give empty results; other columns
are ignored, so their names can't clash. The only growing state is a bounded memo of words.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain, islice

import regex
from pyspark.sql import DataFrame, SparkSession

from modalith.llm.runtime import lean, small_batches

#: The white space of the vocabulary's regular expressions (Unicode White_Space).
_SPACE = "\t-\r \x85\xa0  -     　"
MEMO = 400_000
WINDOW = 64
#: Characters of a text that are encoded at a time, up to the next white space.
SLICE = 1 << 16


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 itself, the others from U+0100 on."""
    plain = set(range(33, 127)) | set(range(161, 173)) | set(range(174, 256))
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
    """Symbols after a token that can still decide it.

    A change at the right end of a text moves left through rules of rising rank: a rule that fires or fails
    there releases or forms its left operand or its product, which a later rule may take as right operand (the
    change then reaches one token further left) or as left operand (it does not). The longest such chain is
    found in one pass over the rules from the last rank to the first; each link spans one longest token.
    """
    as_right: dict[str, int] = {}
    as_left: dict[str, int] = {}
    deepest = 0
    for left, right in reversed(merges):
        whole = left + right
        depth = max(as_right.get(left, 0), as_right.get(whole, 0), as_left.get(left, 0), as_left.get(whole, 0))
        deepest = max(deepest, depth)
        as_right[right] = max(as_right.get(right, 0), depth + 1)
        as_left[left] = max(as_left.get(left, 0), depth)
    longest = max((len((a + b).replace("</w>", "")) for a, b in merges), default=1)
    return (deepest + 2) * longest


class Vocabulary:
    """What the transducer needs of a vocabulary file; plain data, so that it can be broadcast."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.lookahead = sufficient_lookahead(merges)
        self.ranks = {pair: (rank, pair[0] + pair[1]) for rank, pair in reversed(list(enumerate(merges)))}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = split["pattern"]["Regex"].replace(r"\s", _SPACE)
        self.tokens: dict[int, str] = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}


class _Memo(dict):
    """Ids of a word, as native unsigned 32-bit integers; bounded, and filled by the transducer."""

    def __init__(self, fill) -> None:
        super().__init__()
        self.fill = fill

    def __missing__(self, word: str) -> bytes:
        found = self.fill(word)
        if len(word) <= WINDOW:
            if len(self) >= MEMO:
                self.clear()
            self[word] = found
        return found


class Encoder:
    def __init__(self, vocab: Vocabulary) -> None:
        self.v = vocab
        self.alphabet = byte_alphabet()
        self.pieces = regex.compile(vocab.pattern)
        self.spaces = regex.compile(f"[{_SPACE}]+")
        self.space = regex.compile(f"[{_SPACE}]")
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(vocab.special, key=len, reverse=True)) or r"(?!)")
        self.words = _Memo(self._word)

    def _merge(self, symbols: list[str]) -> list[str]:
        """Rank-ordered merging of a bounded buffer, leftmost first among equal ranks."""
        if len(symbols) > 96:
            return self._merge_long(symbols)
        rule = self.v.ranks.get
        pairs = [rule(p) for p in zip(symbols, symbols[1:])]
        while True:
            least, at = None, -1
            for i, found in enumerate(pairs):
                if found is not None and (least is None or found[0] < least):
                    least, at = found[0], i
            if at < 0:
                return symbols
            symbols[at] = pairs[at][1]
            del symbols[at + 1], pairs[at]
            if at:
                pairs[at - 1] = rule((symbols[at - 1], symbols[at]))
            if at < len(pairs):
                pairs[at] = rule((symbols[at], symbols[at + 1]))

    def _merge_long(self, symbols: list[str]) -> list[str]:
        """The same merges from a heap of (rank, place), for buffers that are too long to scan once a rule."""
        ranks, n = self.v.ranks, len(symbols)
        token: list[str | None] = list(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found[0], i) for i in range(n - 1) if (found := ranks.get((symbols[i], symbols[i + 1])))]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            j = after[i]
            if token[i] is None or j >= n:
                continue
            found = ranks.get((token[i], token[j]))
            if found is None or found[0] != rank:
                continue  # one of the two has changed since
            token[i], token[j] = found[1], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (new := ranks.get((token[k], token[after[k]]))):
                    heappush(heap, (new[0], k))
        return [t for t in token if t is not None]

    def stream(self, symbols: Iterator[str]) -> Iterator[int]:
        """Ids of one piece from its symbols, holding at most a few lookaheads of them.

        The stream's last symbol carries the word-end suffix. When the buffer holds more than four lookaheads, it
        is merged and the tokens that end more than one lookahead before its end are emitted: nothing that
        follows can change them. What is left starts at a token edge, so the rest merges as in the whole piece."""
        look, ids = self.v.lookahead, self.v.ids
        full = 4 * look + 1
        buffer = list(islice(symbols, full))
        while len(buffer) == full:
            done = 0
            for token in self._merge(list(buffer)):
                if done + len(token) > full - look:
                    break
                done += len(token)
                yield ids[token]
            del buffer[:done]
            buffer.extend(islice(symbols, full - len(buffer)))
        for token in self._merge(buffer):
            if token in ids:
                yield ids[token]

    def _symbols(self, piece: str) -> Iterator[str]:
        """The byte symbols of a piece, the last with the word-end suffix."""
        data = piece.encode("utf-8", "surrogatepass")
        return chain(map(self.alphabet.__getitem__, data[:-1]), [self.alphabet[data[-1]] + self.v.suffix])

    def _word(self, word: str) -> bytes:
        """Ids of a stretch without white space: normalised, cut into pieces, each piece streamed. No piece, no
        composition and no case mapping reaches across white space, so words are independent."""
        out = array("I")
        for piece in self.pieces.finditer(unicodedata.normalize("NFC", word).replace("Σ", "σ").lower()):
            out.extend(self.stream(self._symbols(piece[0])))
        return out.tobytes()

    def _slices(self, text: str, begin: int, end: int) -> Iterator[str]:
        """text[begin:end] in slices of at least SLICE characters that end before white space."""
        while begin < end:
            m = self.space.search(text, begin + SLICE, end) if end - begin > SLICE else None
            stop = m.start() if m else end
            yield text[begin:stop]
            begin = stop

    def _plain(self, text: str) -> bytes:
        # str.split() also splits at U+001C to U+001F, which the vocabulary's patterns don't
        odd = "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text
        return b"".join(map(self.words.__getitem__, [w for w in self.spaces.split(text) if w] if odd else text.split()))

    def parts(self, text: str | None) -> Iterator[array]:
        """Ids of a whole text, slice by slice: what is held is one slice and its ids, however long the text, unless
        a stretch without white space is longer. Special tokens are taken from the raw text, before it is
        normalised."""
        text, at = text or "", 0
        marks = self.special.finditer(text) if any(s in text for s in self.v.special) else ()
        for m in chain(marks, [None]):
            for part in self._slices(text, at, m.start() if m else len(text)):
                ids = array("I")
                ids.frombytes(self._plain(part))
                yield ids
            if m:
                yield array("I", [self.v.special[m[0]]])
                at = m.end()

    def encode(self, text: str | None) -> array:
        out = array("I")
        for ids in self.parts(text):
            out.extend(ids)
        return out


class Decoder:
    """Incremental byte-to-text state machine: feed ids, take text as soon as its bytes are complete.

    joined=True gives what the library's decode() gives for a file without a decoder: the token strings, with
    one space between. joined=False turns tokens into the bytes that they stand for and word ends into spaces.
    """

    def __init__(self, vocab: Vocabulary, joined: bool = True) -> None:
        self.joined = joined
        self.state = codecs.getincrementaldecoder("utf-8")("replace")
        self.first = True
        if joined:
            self.bytes = {i: t.encode("utf-8") for i, t in vocab.tokens.items()}
        else:
            back = {c: b for b, c in enumerate(byte_alphabet())}
            plain = set(vocab.special.values())
            self.bytes = {}
            for i, t in vocab.tokens.items():
                end = vocab.suffix and t.endswith(vocab.suffix) and i not in plain
                body = t[: -len(vocab.suffix)] if end else t
                self.bytes[i] = (body.encode() if i in plain else bytes(back[c] for c in body)) + b" " * bool(end)

    def feed(self, ids: Iterable[int]) -> str:
        part = (b" " if self.joined else b"").join(map(self.bytes.__getitem__, ids))
        if self.joined and part:
            part, self.first = part if self.first else b" " + part, False
        return self.state.decode(part)

    def end(self) -> str:
        out = self.state.decode(b"", True)
        self.state.reset()
        self.first = True
        return out


@lru_cache(maxsize=4)
def load_vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


_workers: dict[str, tuple[Encoder, Decoder]] = {}


def _coder(path: str, vocab: Vocabulary) -> tuple[Encoder, Decoder]:
    """One encoder and decoder a Python worker, so that the memo outlives a task."""
    if path not in _workers:
        _workers[path] = (Encoder(vocab), Decoder(vocab))
    return _workers[path]


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for every row: whole texts, null as empty, nothing dropped."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(load_vocabulary(vocabulary))

    def run(batches):
        import pyarrow as pa

        enc, _ = _coder(vocabulary, shared.value)
        for b in batches:
            ids = [enc.encode(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([i.tolist() for i in ids], pa.list_(pa.int32()))], names=[id_col, "ids"])

    rows = docs.select(id_col, text_col)
    return rows.mapInArrow(lean(run), f"{id_col} {rows.schema[0].dataType.simpleString()}, ids array<int>")


def roundtrip_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, decode it again, and return digests of both: (id, n_tokens, ids_sha256,
    decoded_sha256). Ids go from the encoder to the digests and the decoder slice by slice and are never held whole."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(load_vocabulary(vocabulary))

    def run(batches):
        import pyarrow as pa

        enc, dec = _coder(vocabulary, shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                n, left, right = [], [], []
                for text in b.column(1).to_pylist():
                    total, ids_digest, digest = 0, hashlib.sha256(), hashlib.sha256()
                    for ids in enc.parts(text):
                        total += len(ids)
                        digest.update(dec.feed(ids).encode("utf-8"))
                        if sys.byteorder == "big":
                            ids.byteswap()
                        ids_digest.update(ids.tobytes())
                    digest.update(dec.end().encode("utf-8"))
                    n.append(total)
                    left.append(ids_digest.hexdigest())
                    right.append(digest.hexdigest())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(left), pa.array(right)], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(id_col, text_col)
    return rows.mapInArrow(lean(run), f"{id_col} {rows.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
