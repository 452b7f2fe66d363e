"""BPE encoding and decoding by a bounded-lookahead streaming transducer.

`Transducer` reads a pre-token symbol by symbol. Of the encoding of each prefix it keeps the last token alone: the one token that
ends there and forms a valid pair with the last token of the prefix before it (a pair is valid if its own text encodes to just that
pair; an encoding is right if and only if all its adjacent pairs are). A token is stable, and goes out, once the back pointers of
all prefixes that a later token could still follow, the last `lookahead` ones, run through it; what lies before is forgotten, so
memory doesn't grow with the pre-token. `lookahead` follows from the merge list: the most symbols of one token, beyond which no later
token can reach. Every pre-token goes through it; the outputs for short ones are remembered, up to CACHE of them.

`Tokenizer` does what a tokenizer file of this kind says: special tokens, NFC, lower case, the split pattern, bytes as characters,
and the end-of-word mark; the files' other settings are refused. A text is read in pieces of about PIECE characters, cut before white
space, which no pre-token holds and no normal form joins with what stands before it; ids go out piece by piece.

Decoders take ids as they come. `TokenDecoder` gives what the library's decode gives for a file without decoder: the tokens'
characters for bytes, a blank between tokens; its state is whether a token went before. `TextDecoder` gives text again: a state machine
over UTF-8 bytes that gives out whole characters only.

Null texts count as empty and have no tokens; repeated rows are encoded each; the other columns of the input pass through
`encode_texts`, where columns of the results' names are replaced.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, StringType

from .common import map_arrow, table

#: Pre-tokens that a worker remembers (of about 200 bytes each, twice as many at most); more bytes than LONG aren't remembered.
CACHE, LONG = 300_000, 48
#: Texts whose ids and tokens a worker holds at once in encode_texts, which gives them out; digests hold one piece.
SLICE = 200
#: Characters of a text that are encoded together, about.
PIECE = 1 << 16
#: Pairs of tokens that a worker remembers to be valid or not.
PAIRS = 150_000
_NONE = 0xFFFFF << 20
#: Symbols that a transducer reads between two looks for stable tokens.
STEP = 64


def byte_characters() -> list[str]:
    """The printable character for each byte: itself if it is a visible Latin-1 character, else one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in visible else next(hidden)) for b in range(256)]


class Merges:
    """The merge list with the pair test; end: the end-of-word mark."""

    def __init__(self, merges: Iterable[tuple[str, str]], vocab: dict[str, int], end: str):
        self.rank = {tuple(m): i for i, m in enumerate(merges)}
        self.vocab, self.end = vocab, end
        self.lookahead = max((len(t.removesuffix(end) if end else t) for t in vocab), default=1)
        self.follows = _Follows(self)

    def symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and token != self.end:
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def encode(self, symbols: list[str]) -> list[str]:
        """The encoding by its definition: the first merge of the list that applies, leftmost first, until none does."""
        while len(symbols) > 1:
            ranked = [(r, i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := self.rank.get(p)) is not None]
            if not ranked:
                break
            i = min(ranked)[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols


class _Follows(dict):
    """Whether a token can follow another (or none) in an encoding, by id << 20 | id; forgets all when full."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges = merges
        self.text_of = {i: t for t, i in merges.vocab.items()}

    def __missing__(self, key: int) -> bool:
        if len(self) > PAIRS:
            self.clear()
        m, token = self.merges, self.text_of[key & 0xFFFFF]
        value = m.encode(m.symbols(token)) == [token]
        if value and key >> 20 != _NONE >> 20:
            before = self.text_of[key >> 20]
            value = m.encode(m.symbols(before) + m.symbols(token)) == [before, token]
        self[key] = value
        return value


class Transducer:
    """feed() symbols, one character each, then close() with the last one; both give the ids that have become stable."""

    def __init__(self, merges: Merges):
        #: Of what isn't forgotten: the symbols; by prefix the last token (its id << 20) and its length; at 0 the last stable token, if any.
        self.m, self.text, self.last, self.sizes = merges, "", [_NONE], [0]

    def _read(self, symbols: str, end: str = "") -> None:
        """Reads symbols; `end` belongs to the last one."""
        text, last, sizes, vocab, follows, reach = self.text + symbols, self.last, self.sizes, self.m.vocab.get, self.m.follows, self.m.lookahead
        n = len(text)
        for k in range(len(last), n + 1):
            for at in range(k - 1, max(k - reach, 0) - 1, -1):
                token = vocab(text[at:k] if k < n else text[at:] + end)
                if token is not None and follows[last[at] | token]:
                    last.append(token << 20)
                    sizes.append(k - at)
                    break
            else:
                raise ValueError("no token ends here")
        self.text = text

    def feed(self, symbols: str) -> list[int]:
        out = []
        for at in range(0, len(symbols), STEP):
            self._read(symbols[at : at + STEP])
            if len(self.last) > self.m.lookahead + 1:
                out += self._stable()
        return out

    def close(self, symbol: str) -> list[int]:
        self._read(symbol, self.m.end)
        return self._tokens(len(self.last) - 1)

    def _tokens(self, at: int) -> list[int]:
        out = []
        while at > 0:
            out.append(self.last[at] >> 20)
            at -= self.sizes[at]
        out.reverse()
        return out

    def _path(self, at: int) -> set[int]:
        path = {at}
        while at > 0:
            at -= self.sizes[at]
            path.add(at)
        return path

    def _stable(self) -> list[int]:
        n = len(self.last) - 1
        common = self._path(n)
        for at in range(n - 1, n - self.m.lookahead - 1, -1):
            common &= self._path(at)
        to = max(common, default=0)
        if to <= 0:
            return []
        out = self._tokens(to)
        self.last, self.sizes, self.text = self.last[to:], [0, *self.sizes[to + 1 :]], self.text[to:]  # the last stable token stays, for the pairs to come
        return out


class _Memo(dict):
    """Short pre-tokens' encodings; when full, only those asked for again outlive the next filling."""

    def __init__(self, missing):
        super().__init__()
        self.missing, self.old = missing, {}

    def __missing__(self, key):
        value = self.old.get(key) or self.missing(key)
        if len(key) <= LONG:
            self[key] = value
        return value

    def age(self, most: int) -> None:
        if len(self) > most:
            self.old = dict(self)
            self.clear()


class Tokenizer:
    """Of a tokenizer file whose model is BPE with a lower-casing normalizer and an inverted split pattern."""

    def __init__(self, path: str, remember: int = CACHE):
        self.remember = remember
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, steps = told["model"], told["normalizer"]["normalizers"]
        if model["type"] != "BPE" or [x["type"] for x in steps] != ["NFC", "Replace", "Lowercase"] or told["decoder"] or model["unk_token"] or model["byte_fallback"] or model["ignore_merges"]:
            raise ValueError(f"a tokenizer of another kind: {path}")
        split, level = told["pre_tokenizer"]["pretokenizers"]
        if not split["invert"] or split["behavior"] != "Removed" or level["type"] != "ByteLevel" or level["add_prefix_space"] or level["use_regex"]:
            raise ValueError(f"another pre-tokenizer: {path}")
        self.end = model["end_of_word_suffix"] or ""
        self.vocab = model["vocab"]
        self.merges = Merges([tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]], self.vocab, self.end)
        self.special = {x["content"]: x["id"] for x in told["added_tokens"]}
        self.pattern = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.specials = regex.compile("|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.by_byte = {i: c for i, c in enumerate(byte_characters())}
        self.text_of = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.memo = _Memo(self._encoded)

    def normalized(self, text: str) -> str:
        # each character by itself: Python alone knows a final sigma
        return unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()

    def stream(self, symbols: str) -> Iterator[int]:
        """The ids of one pre-token, given as characters for bytes, as they become stable."""
        t = Transducer(self.merges)
        for at in range(0, len(symbols) - 1, STEP):
            yield from t.feed(symbols[at : min(at + STEP, len(symbols) - 1)])
        yield from t.close(symbols[-1:])

    def _encoded(self, word: str) -> bytes:
        """A pre-token's ids as little-endian 32-bit integers."""
        return _little(array("I", self.stream(word.encode().decode("latin-1").translate(self.by_byte))))

    def encode(self, text: str | None) -> Iterator[bytes]:
        """The ids as little-endian 32-bit integers, piece by piece."""
        known = self.memo.__getitem__
        for piece in _pieces(text or ""):
            ids, at = [], 0
            for m in [*(self.specials.finditer(piece) if self.specials and any(x in piece for x in self.special) else ()), None]:
                part = self.normalized(piece[at : m.start()] if m else piece[at:])
                ids += map(known, self.pattern.findall(part))
                if m:
                    ids.append(_little(array("I", [self.special[m[0]]])))
                    at = m.end()
            self.memo.age(self.remember)
            yield b"".join(ids)


_WHITE = re.compile("[ \t\n\r]")


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PIECE:
        m = _WHITE.search(text, at + PIECE)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def _little(ids: array) -> bytes:
    if sys.byteorder != "little":
        ids.byteswap()
    return ids.tobytes()


class TokenDecoder:
    """Ids (as bytes) to what the library gives for a file without decoder, piece by piece."""

    def __init__(self, tokenizer: Tokenizer):
        self.t, self.begun = tokenizer, False

    def feed(self, ids: bytes) -> str:
        if not ids:
            return ""
        out = " ".join(map(self.t.text_of.__getitem__, _numbers(ids)))
        out, self.begun = " " + out if self.begun else out, True
        return out

    def close(self) -> str:
        return ""


class TextDecoder:
    """Ids (as bytes) to text, piece by piece: bytes go through a UTF-8 state machine, the end-of-word mark becomes a blank."""

    def __init__(self, tokenizer: Tokenizer):
        self.t = tokenizer
        self.byte_of = {c: b for b, c in self.t.by_byte.items()}
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def _one(self, token_id: int) -> str:
        token = self.t.text_of[token_id]
        if token_id in self.t.special.values():
            return self.state.decode(b"", True) + token
        end = bool(self.t.end) and token.endswith(self.t.end)
        out = self.state.decode(bytes(self.byte_of[c] for c in (token[: -len(self.t.end)] if end else token)), end)
        return out + " " * end

    def feed(self, ids: bytes) -> str:
        return "".join(map(self._one, _numbers(ids)))

    def close(self) -> str:
        return self.state.decode(b"", True)


def _numbers(ids: bytes) -> Iterable[int]:
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out


@cache
def tokenizer(path: str, remember: int = CACHE) -> Tokenizer:
    return Tokenizer(path, remember)


def public_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_texts(df: DataFrame, path: str | None = None, text: str = "text", remember: int = CACHE) -> DataFrame:
    """df with ids (array<int>) and decoded (what the library's decode gives). path: of the tokenizer file, on every executor.

    remember: pre-tokens that a worker remembers; fewer take less memory and more time, and give the same.
    """
    kept = [c for c in df.columns if c not in ("ids", "decoded")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path or public_path(), remember)
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, len(b), SLICE)):
            ids, decoded, offsets = [], [], [0]
            for x in batch.column(text).to_pylist():
                d, parts = TokenDecoder(t), []
                for piece in t.encode(x):
                    ids.append(piece)
                    parts.append(d.feed(piece))
                decoded.append("".join([*parts, d.close()]))
                offsets.append(sum(map(len, ids[-len(parts) :])) // 4 + offsets[-1])
            flat = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(ids))])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat), pa.array(decoded, pa.string())], names=[*kept, "ids", "decoded"])

    schema = df.select(*kept).schema.add("ids", ArrayType(IntegerType())).add("decoded", StringType())
    return map_arrow(df, run, schema)


def decode_texts(df: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """df with text: the ids decoded by TextDecoder; a null list is an empty text."""
    kept = [c for c in df.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path or public_path())
        for batch in batches:
            texts = []
            for row in batch.column(ids).to_pylist():
                d = TextDecoder(t)
                texts.append(d.feed(_little(array("I", row or ()))) + d.close())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, "text"])

    return map_arrow(df, run, df.select(*kept).schema.add("text", StringType()))


def digests(df: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text; ids are decoded and hashed as they come, so that a worker holds a piece of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path or public_path())
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                d, n, ids, decoded = TokenDecoder(t), 0, hashlib.sha256(), hashlib.sha256()
                for piece in t.encode(text):
                    n += len(piece) // 4
                    ids.update(piece)
                    decoded.update(d.feed(piece).encode())
                decoded.update(d.close().encode())
                out.append((n, ids.hexdigest(), decoded.hexdigest()))
            n, a, b = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(df.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
