"""What extract.looking_ahead says of tokens, for the texts of a batch at once: running sums, sorts and searches over Arrow's pieces.

Spark cuts the texts and deals them out; a task sees a slice of about SLICE bytes (one text at least, of at most extract.LONG bytes), cuts
what stands between strings and the like into words and signs, and gives only the tokens that can begin a fact, each with what is asked of it. A place of -1 means none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are looked at together.
SLICE = 500_000
#: Ends each piece of a text that comes as one string; no text that comes so has it itself.
END = "\x01"
NAMES = ("(", "{", "[", ")", "}", "]", "=", "=>", ";", ">", "import", "export", "function", "class", "interface", "enum", "type", "Route", "path", "const", "let", "var", "createContext", '"')
CODE = {name: i for i, name in enumerate(NAMES)}
_STRING, _HOOK, _OTHER = CODE['"'], len(NAMES), len(NAMES) + 1
#: The codes that begin what facts are made from; exports only outside braces.
BEGINS = {
    "imports": ("import",), "exports": ("export",), "functions": ("function",), "components": ("function", "class", "const", "let", "var"), "hooks": ("createContext",), "routes": ("Route",),
    "symbols": ("function", "class", "interface", "enum", "type", "const", "let", "var"),
}
_PLACE = "struct<at:int,line:int,column:int>"
_SHORT_PAREN = "struct<sym:string,at:int,end:int,was1:string>"
_BRACE = "struct<at:int,end:int,after:struct<then:string,raw2:string>>"
_PAREN = "struct<sym:string,at:int,end:int,was1:string,then:string,closed:struct<then:string,equals:string,body_end:int>,inner:struct<sym:string,at:int,end:int>>"
_SHAPES = {
    "sym": "string", "at": "int", "line": "int", "column": "int", "braces": "int", "then": "string", "was1": "string", "was2": "string", "raw1": "string", "raw2": "string", "opened": "string", "end": "int", "was": _PLACE,
    "outside": f"struct<sym:string,raw:string,was1:string,was:{_PLACE}>", "brace": _BRACE, "arrow": "struct<at:int>", "stop": "int", "quoted": "struct<raw:string>", "paren": _PAREN,
    "assigned": f"struct<sym:string,at:int,then:string,paren:{_PAREN},body_end:int>", "tag_end": "int", "path_said": "struct<at:int,raw:string>",
}
_ASKS = {
    "imports": "then was1 raw1 raw2 outside", "exports": "braces then was1 brace arrow stop quoted", "functions": "then paren", "components": "then paren brace stop assigned", "hooks": "column then was1 was2 paren", "routes": "was1 was path_said tag_end",
    "symbols": "then", "odd": "column opened", "unclosed": "column end",
}


def columns(needed: set[str]) -> list[str]:
    asked = {c for n in needed for c in _ASKS[n].split()} | {"sym", "at", "line"}
    return [c for c in _SHAPES if c in asked]


def shape(needed: set[str]) -> str:
    own = {**_SHAPES, **({} if "components" in needed else {"paren": _SHORT_PAREN})}
    return f"array<struct<{','.join(f'{c}:{own[c]}' for c in columns(needed))}>>"


def _table(codes: Iterable[int], size: int) -> np.ndarray:
    table = np.zeros(size, bool)
    table[[*codes]] = True
    return table


# by first byte: white space, signs that stand alone, and what begins the names of several characters
_WHITE, _FIRST = _table((9, 10, 11, 12, 13, 32), 256), _table({ord(x[0]) for x in NAMES if len(x) > 1} | {ord("u")}, 256)
# of single signs, which stand alone but for =>, words and white space; no sign beyond ASCII comes with others in its piece
_SIGN = np.ones(256, np.uint8)
_SIGN[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_$", *range(128, 256)]], _SIGN[_WHITE] = 0, 2
_MARKS = _table(b"/'\"`", 256)
_ONE = np.full(256, _OTHER, np.int16)
_ONE[[ord(x) for x in NAMES if len(x) == 1]] = [CODE[x] for x in NAMES if len(x) == 1]


def _parted(data: np.ndarray, bounds: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bounds of words, blanks and signs, and how many each text has: pieces that are not marked are cut where these begin."""
    kind = _SIGN[data]
    new = np.ones(len(data), bool)
    new[1:] = ((kind[1:] == 1) & ((data[1:] != 62) | (data[:-1] != 61))) | (kind[1:] != kind[:-1])
    size = np.diff(bounds)
    new &= ~np.repeat((size > 1) & _MARKS[data[bounds[:-1]]], size)
    new[bounds[:-1]] = True
    starts = np.flatnonzero(new)
    return np.append(starts, len(data)), np.diff(np.searchsorted(starts, bounds[np.append(0, np.cumsum(counts))]))


class _Tokens:
    """The tokens of some texts: code, file, at, and, when they are asked for, line, column, braces, and where brackets close (`close`) and open (`open`).

    Places are counted in bytes, and told in characters.
    """

    def __init__(self, pieces: pa.Array, counts: np.ndarray):
        n = len(pieces)
        bounds = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + n + 1]
        self.data = data = np.frombuffer(pieces.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
        bounds, counts = _parted(data, bounds - bounds[0], counts)
        pieces = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data))
        first, more = data[bounds[:-1]], np.diff(bounds) > 1
        second = data[np.minimum(bounds[:-1] + 1, len(data) - 1)]
        comment = more & (first == 47) & ((second == 47) | (second == 42))
        self.at_piece = keep = np.flatnonzero(~(_WHITE[first] | comment))
        self.pieces, self.n = pieces, len(keep)
        self.byte, self.sign, more = bounds[keep], first[keep], more[keep]
        self.quoted = more & (self.sign == 39) | (self.sign == 34)
        self.other = more & ((self.sign == 96) | (self.sign == 47))
        # characters before a byte: those that no earlier byte has begun
        self.wide = None if data.max(initial=0) < 128 else np.append(0, np.cumsum((data & 0xC0) != 0x80))
        self.file = np.repeat(np.arange(len(counts)), counts)[keep]
        self.begin = bounds[np.cumsum(counts) - counts]  # of each file
        self.first = np.searchsorted(self.file, np.arange(len(counts)))
        self.at = self.place(self.byte) - self.place(self.begin)[self.file]
        self.code = np.where(more, _OTHER, _ONE[self.sign])
        named = np.flatnonzero(more & _FIRST[self.sign])
        words = pieces.take(pa.array(keep[named]))
        code = pc.fill_null(pc.index_in(words, value_set=pa.array(NAMES)), _OTHER).to_numpy().copy()
        code[pc.starts_with(words, "use").to_numpy(zero_copy_only=False)] = _HOOK
        self.code[named] = code
        self.code[self.quoted] = _STRING
        self.opens, self.closes = self.code < 3, (self.code >= 3) & (self.code < 6)
        self.where: dict[tuple, np.ndarray] = {}

    def place(self, byte: np.ndarray) -> np.ndarray:
        return byte.astype(np.int64) if self.wide is None else self.wide[byte]

    @cached_property
    def feeds(self) -> np.ndarray:
        return np.flatnonzero(self.data == 10)

    def line_column(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each of the rows; -1 for none."""
        if not self.n:
            return (np.full(len(rows), -1),) * 2
        file = self.file[rows]
        before, fed = np.searchsorted(self.feeds, self.begin)[file], np.searchsorted(self.feeds, self.byte[rows])
        start = self.begin[file] if not len(self.feeds) else np.where(fed > before, self.feeds[np.maximum(fed - 1, 0)] + 1, self.begin[file])
        return np.where(rows >= 0, fed - before + 1, -1), np.where(rows >= 0, self.place(self.byte[rows]) - self.place(start) + 1, -1)

    def _open_before(self, up: np.ndarray, down: np.ndarray) -> np.ndarray:
        """How many are open before each token, in its file."""
        change = up.astype(np.int64) - down
        before = np.cumsum(change) - change
        return before - before[self.first[self.file]] if self.n else before

    @cached_property
    def braces(self) -> np.ndarray:
        return self._open_before(self.code == CODE["{"], self.code == CODE["}"])

    @cached_property
    def _brackets(self) -> tuple[np.ndarray, np.ndarray]:
        level = self._open_before(self.opens, self.closes) + self.opens
        brackets = np.flatnonzero(self.opens | self.closes)
        # files and levels in one number
        least, most = (level[brackets].min(), level[brackets].max()) if len(brackets) else (0, 0)
        part = self.file[brackets] * (most - least + 1) + level[brackets] - least
        order = np.argsort(part, kind="stable")
        brackets, part = brackets[order], part[order]
        a, b = brackets[:-1], brackets[1:]
        same = part[:-1] == part[1:]
        close, open_ = np.full(self.n, -1), np.full(self.n, -1)
        close[a[same]], open_[b[same]] = b[same], a[same]
        close[self.closes] = -1
        return close, open_

    @property
    def close(self) -> np.ndarray:
        return self._brackets[0]

    @property
    def open(self) -> np.ndarray:
        return self._brackets[1]

    def shifted(self, rows: np.ndarray, k: int) -> np.ndarray:
        """The k-th token after (before: negative) each of the rows, in its file."""
        to = np.clip(rows + k, 0, self.n - 1)
        return np.where((rows >= 0) & (rows + k == to) & (self.file[to] == self.file[rows]), to, -1)

    def ahead(self, rows: np.ndarray, *names: str, among: np.ndarray | None = None) -> np.ndarray:
        """The next token of these names after each of the rows, in its file."""
        if among is None:
            if names not in self.where:
                self.where[names] = np.flatnonzero(_table((CODE[x] for x in names), _OTHER + 1)[self.code])
            among = self.where[names]
        if not len(among):
            return np.full(len(rows), -1)
        k = np.searchsorted(among, rows, side="right")
        to = among[np.minimum(k, len(among) - 1)]
        return np.where((rows >= 0) & (k < len(among)) & (self.file[to] == self.file[rows]), to, -1)

    def of(self, values: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.where(rows >= 0, values[rows], -1) if self.n else np.full(len(rows), -1)

    def end(self, rows: np.ndarray) -> np.ndarray:
        """Behind the bracket that closes what the rows open."""
        to = self.of(self.close, rows)
        return np.where(to >= 0, self.of(self.at, to) + 1, -1)

    def body_end(self, rows: np.ndarray) -> np.ndarray:
        arrow, brace = self.ahead(rows, "=>"), self.ahead(rows, "{")
        after = self.shifted(arrow, 1)
        block = np.isin(self.of(self.code, after), (CODE["("], CODE["{"]))
        expression = np.where(block, self.end(after), self.of(self.at, self.ahead(rows, ";")))
        return np.where((arrow >= 0) & ((brace < 0) | (arrow < brace)), expression, self.end(brace))

    def sym(self, rows: np.ndarray) -> pa.Array:
        own = self.pieces.take(pa.array(self.at_piece[rows] if self.n else rows, mask=rows < 0))
        own = pc.if_else(pa.array(self.of(self.quoted, rows) == 1), '"', own)
        return pc.if_else(pa.array(self.of(self.other, rows) == 1), pc.if_else(pa.array(self.of(self.sign, rows) == 96), "`", "/"), own)

    def raw(self, rows: np.ndarray) -> pa.Array:
        on = self.of(self.quoted, rows) == 1
        return pc.utf8_slice_codeunits(self.pieces.take(pa.array(np.where(on, self.at_piece[rows], 0), mask=~on)), 1, -1)

    def then(self, rows: np.ndarray, n: int = 7) -> pa.Array:
        if not len(rows):
            return pa.array([], pa.string())
        said = pc.binary_join_element_wise(*(pc.fill_null(self.sym(self.shifted(rows, k)), "") for k in range(1, n + 1)), " ")
        return pc.if_else(pa.array(rows >= 0), pc.utf8_rtrim(said, " "), pa.scalar(None, pa.string()))  # what is missing is at the end


def _int(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.int32), mask=values < 0)


def _struct(rows: np.ndarray, **fields: pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays([*fields.values()], names=[*fields], mask=pa.array(rows < 0))


def _place(t: _Tokens, rows: np.ndarray) -> pa.Array:
    line, column = t.line_column(rows)
    return _struct(rows, at=_int(t.of(t.at, rows)), line=_int(line), column=_int(column))


def _short_paren(t: _Tokens, rows: np.ndarray) -> pa.Array:
    first = t.ahead(rows, "(", ")")
    return _struct(first, sym=t.sym(first), at=_int(t.of(t.at, first)), end=_int(t.end(first)), was1=t.sym(t.shifted(first, -1)))


def _paren(t: _Tokens, rows: np.ndarray) -> pa.Array:
    first = t.ahead(rows, "(", ")")
    opened = np.where(t.of(t.code, first) == CODE["("], first, -1)
    closed, inner = t.of(t.close, opened), t.ahead(opened, "(", ")")
    told = _struct(closed, then=t.then(closed, 1), equals=t.sym(t.ahead(closed, "=", "=>")), body_end=_int(np.where(closed >= 0, t.body_end(closed), -1)))
    return _struct(first, sym=t.sym(first), at=_int(t.of(t.at, first)), end=_int(t.end(first)), was1=t.sym(t.shifted(first, -1)), then=t.then(first, 4), closed=told, inner=_struct(inner, sym=t.sym(inner), at=_int(t.of(t.at, inner)), end=_int(t.end(inner))))


def _assigned(t: _Tokens, rows: np.ndarray) -> pa.Array:
    to = t.ahead(rows, "=", "=>")
    sign = np.where(t.of(t.code, to) == CODE["="], to, -1)
    return _struct(to, sym=t.sym(to), at=_int(t.of(t.at, to)), then=t.then(to, 4), paren=_paren(t, sign), body_end=_int(np.where(sign >= 0, t.body_end(sign), -1)))


def _brace(t: _Tokens, rows: np.ndarray) -> pa.Array:
    to = t.ahead(rows, "{")
    closer = t.of(t.close, to)
    said = t.raw(t.shifted(np.where(t.of(t.code, closer) == CODE["}"], closer, -1), 2))
    return _struct(to, at=_int(t.of(t.at, to)), end=_int(t.end(to)), after=_struct(closer, then=t.then(closer, 2), raw2=said))


def _outside(t: _Tokens, rows: np.ndarray) -> pa.Array:
    to = t.ahead(rows, '"', ";", ">", "(", ")", "[", "]", "=", "=>")
    return _struct(to, sym=t.sym(to), raw=t.raw(to), was1=t.sym(t.shifted(to, -1)), was=_place(t, t.shifted(to, -1)))


def _path_said(t: _Tokens, rows: np.ndarray) -> pa.Array:
    paths = np.flatnonzero(t.code == CODE["path"])
    said = t.then(paths, 3)
    paths = paths[pc.match_substring_regex(said, r'^= (?:\{ )?"').to_numpy(zero_copy_only=False)] if len(paths) else paths
    to = t.ahead(rows, among=paths)
    straight = t.of(t.code, t.shifted(to, 2)) == _STRING
    return _struct(to, at=_int(t.of(t.at, to)), raw=t.raw(np.where(straight, t.shifted(to, 2), t.shifted(to, 3))))


_MADE: dict[str, Callable[[_Tokens, np.ndarray], pa.Array]] = {
    "sym": lambda t, r: t.sym(r), "at": lambda t, r: _int(t.at[r]), "line": lambda t, r: _int(t.line_column(r)[0]), "column": lambda t, r: _int(t.line_column(r)[1]),
    "braces": lambda t, r: pa.array(t.braces[r].astype(np.int32)), "then": lambda t, r: t.then(r), "was1": lambda t, r: t.sym(t.shifted(r, -1)), "was2": lambda t, r: t.sym(t.shifted(r, -2)), "raw1": lambda t, r: t.raw(t.shifted(r, 1)),
    "raw2": lambda t, r: t.raw(t.shifted(r, 2)), "opened": lambda t, r: t.sym(t.open[r]), "end": lambda t, r: _int(t.end(r)), "was": lambda t, r: _place(t, t.shifted(r, -1)), "outside": _outside, "brace": _brace,
    "arrow": lambda t, r: _struct(t.ahead(r, "=>"), at=_int(t.of(t.at, t.ahead(r, "=>")))), "stop": lambda t, r: _int(t.of(t.at, t.ahead(r, ";"))), "quoted": lambda t, r: _struct(t.ahead(r, '"'), raw=t.raw(t.ahead(r, '"'))),
    "paren": _paren, "assigned": _assigned, "tag_end": lambda t, r: _int(t.of(t.at, t.ahead(r, ">", "=>"))), "path_said": _path_said,
}


_BINDS = ("const", "let", "var")
#: The tokens that a column is asked of, where that isn't all; others have none.
_OF = {
    "paren": ("function", "createContext"), "brace": ("class", "export"), "arrow": ("export",), "stop": ("class", "export", *_BINDS), "quoted": ("export",), "assigned": _BINDS, "outside": ("import",), "raw1": ("import",), "raw2": ("import",),
    "was": ("Route",), "path_said": ("Route",), "tag_end": ("Route",),
}


def _made(t: _Tokens, column: str, rows: np.ndarray, needed: set[str]) -> pa.Array:
    make = _short_paren if column == "paren" and "components" not in needed else _MADE[column]
    if column not in _OF or not len(rows):
        return make(t, rows)
    on = _table([*(CODE[x] for x in _OF[column]), *([_HOOK] if column == "paren" else [])], _OTHER + 1)[t.code[rows]]
    if column == "assigned":  # what isn't a component's name isn't asked
        on &= _capital(t, rows)
    if on.all():
        return make(t, rows)
    return make(t, rows[on]).take(pa.array(np.where(on, np.cumsum(on) - 1, 0), mask=~on))


def _capital(t: _Tokens, rows: np.ndarray) -> np.ndarray:
    sign = t.of(t.sign, t.shifted(rows, 1))
    return (sign >= 65) & (sign <= 90)


def _heads(t: _Tokens, needed: set[str]) -> np.ndarray:
    """The tokens that begin what is needed."""
    names = {CODE[x] for n in needed if n in BEGINS for x in BEGINS[n]}
    on = _table([*names - {CODE["export"]}, *([_HOOK] if "hooks" in needed else [])], _OTHER + 1)[t.code]
    if "exports" in needed:
        on |= (t.code == CODE["export"]) & (t.braces == 0)
    if "unclosed" in needed:
        on |= t.opens & (t.close < 0)
    if "odd" in needed:
        on |= t.closes & (t.of(t.code, t.open) != t.code - 3)
    rows = np.flatnonzero(on)
    # what the facts would pass by isn't told: hooks that aren't called, and names that aren't components'
    if "hooks" in needed:
        after = t.of(t.sign, t.shifted(rows, 1))
        rows = rows[~_table((_HOOK, CODE["createContext"]), _OTHER + 1)[t.code[rows]] | (after == 40) | (after == 60)]
    if "components" in needed and "symbols" not in needed:
        rows = rows[~_table((CODE[x] for x in _BINDS), _OTHER + 1)[t.code[rows]] | _capital(t, rows)]
    return rows


def _cut(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pieces of a column's texts and how many each has: a text is a list of them, or a string where each ends in END."""
    if not pa.types.is_string(column.type):
        return column.flatten(), pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    on = data == ord(END)
    ends = np.flatnonzero(on)
    counts = np.diff(np.searchsorted(ends, bounds - bounds[0]))
    offsets = np.concatenate(([0], ends - np.arange(len(ends)))).astype(np.int32)
    return pa.StringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(data[~on])), counts


def _places(pieces: pa.Array, sizes: np.ndarray) -> np.ndarray:
    """Where each text begins in the pieces' bytes, and where the last one ends."""
    if not len(pieces):
        return np.zeros(len(sizes), np.int32)
    return np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1][sizes]


def _whole(pieces: pa.Array, places: np.ndarray) -> pa.Array:
    """The texts again, without a copy: the pieces of one stand side by side."""
    return pa.StringArray.from_buffers(len(places) - 1, pa.py_buffer(places), pieces.buffers()[2] if len(pieces) else pa.py_buffer(b""))


def runner(needed: set[str], asked: list[str], text: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches with their last column, the pieces of a text, replaced by the tokens that begin what is needed, and before these by the text if that is asked. The first column is the file's id; without one a text tells nothing."""

    def told(batch: pa.RecordBatch, pieces: pa.Array, counts: np.ndarray, texts: list[pa.Array]) -> pa.RecordBatch:
        t = _Tokens(pieces, counts) if len(pieces) else None
        rows = _heads(t, needed) if t else np.zeros(0, np.int64)
        if t and batch.column(0).null_count:
            rows = rows[batch.column(0).is_valid().to_numpy(zero_copy_only=False)[t.file[rows]]]
        ends = np.searchsorted(t.file[rows], np.arange(len(counts) + 1)) if t else np.zeros(len(counts) + 1)
        t = t or _Tokens(pa.array([";"]), np.array([1]))
        own = pa.StructArray.from_arrays([_made(t, c, rows, needed) for c in asked], names=asked)
        made = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), own)
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *texts, made], names=[*batch.schema.names[:-1], *(["text"] if texts else []), "heads"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces, counts = _cut(batch.column(batch.num_columns - 1))
            sizes = np.concatenate(([0], np.cumsum(counts)))
            places = _places(pieces, sizes)
            whole = _whole(pieces, places) if text else None
            at = 0
            while at < len(batch):
                to = max(at + 1, int(np.searchsorted(places, places[at] + SLICE, side="right")) - 1)
                yield told(batch.slice(at, to - at), pieces.slice(sizes[at], sizes[to] - sizes[at]), counts[at:to], [] if whole is None else [whole.slice(at, to - at)])
                at = to

    return run
