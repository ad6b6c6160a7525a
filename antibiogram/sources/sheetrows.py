"""Rows of a sheet's XML, some thousands at a time.

``plain`` takes bytes of whole rows and finds tags and texts by their places, as arrays; nothing is done cell by cell. It takes
only rows of a form in which that gives what an XML parser gives, and returns None for all others: formulas, rich texts, comments,
namespaces of a row's own, cells out of order, what is not well-formed. The caller then parses those bytes."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Kinds of tags; 0 is any other.
ROW, ROW_EMPTY, ROW_END, C, C_EMPTY, C_END, V, V_END, IS, IS_END, T, T_END = range(1, 13)
#: By the two bytes after "<".
STARTS = {"ro": ROW, "/r": ROW_END, "c ": C, "c>": C, "c/": C, "/c": C_END, "v>": V, "/v": V_END, "is": IS, "/i": IS_END, "t>": T, "t ": T, "/t": T_END}
#: Bytes from "<" to ">", where they are fixed.
LENGTHS = {ROW_END: 5, C_END: 3, V: 2, V_END: 3, IS: 3, IS_END: 4, T_END: 3}
_IN_ROW = (C, C_EMPTY, ROW_END)
#: What may come after a tag.
NEXT = {
    ROW: _IN_ROW, ROW_EMPTY: (ROW, ROW_EMPTY), ROW_END: (ROW, ROW_EMPTY), C: (C_END, V, IS), C_EMPTY: _IN_ROW, C_END: _IN_ROW,
    V: (V_END,), V_END: (C_END,), IS: (T,), T: (T_END,), T_END: (IS_END,), IS_END: (C_END,),
}
EMPTY = np.zeros(16, np.uint8)
EMPTY[[ROW, C]] = ROW_EMPTY, C_EMPTY
KIND = np.zeros(1 << 16, np.uint8)
for _start, _kind in STARTS.items():
    KIND[int.from_bytes(_start.encode(), "little")] = _kind
LENGTH = np.zeros(16, np.int64)
for _kind, _length in LENGTHS.items():
    LENGTH[_kind] = _length
FOLLOWS = np.zeros(256, bool)
for _kind, _kinds in NEXT.items():
    FOLLOWS[[16 * _kind + k for k in _kinds]] = True
ATTRIBUTES = re.compile(r'(?: +[\w:]+="[^"<&]*")* *')
ATTRIBUTE = re.compile(r'([\w:]+)="([^"]*)"')
ROW_ATTRIBUTES = r'^row(?: +[A-Za-z0-9_:]+="[^"<&]*")* */?$'
ROW_NUMBER = r' r="(?P<r>[0-9]+)"'
#: Different attributes of cells, beyond which the row's number is taken out of their references.
FEW = 64


@dataclass
class Rows:
    """Rows as they come: their numbers, which of them have a cell that is not null, and for each the places of its cells' texts
    in ``pool``, -1 for null."""

    numbers: np.ndarray
    filled: np.ndarray
    cells: np.ndarray
    pool: pa.Array


def _between(data: bytes, begins: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The strings between these places, which are in order, each after what comes before it; nothing is copied."""
    places = np.zeros(2 * len(begins) + 1, np.int32)
    places[1::2], places[2::2] = begins, ends
    return pa.StringArray.from_buffers(2 * len(begins), pa.py_buffer(places), pa.py_buffer(data))


def _texts(data: bytes, begins: np.ndarray, ends: np.ndarray) -> pa.Array:
    return _between(data, begins, ends).take(pa.array(np.arange(1, 2 * len(begins), 2)))


def mapped(texts: pa.Array, f: Callable[[str], str | None]) -> pa.Array:
    """``f`` of each text, found once for each that is different."""
    coded = texts.dictionary_encode()
    return pa.array([f(t) for t in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)


def _decoded(text: str) -> str:
    return ElementTree.fromstring(f"<t>{text}</t>").text if "&" in text else text


def column(ref: str) -> int:
    """0 for A1, 26 for AA1."""
    k = 0
    for c in ref:
        if not c.isalpha():
            break
        k = 26 * k + ord(c.upper()) - 64
    return k - 1


def _attributes(tags: pa.Array) -> tuple[np.ndarray, list[dict[str, str]]] | None:
    """Number of each cell's attributes, and the attributes by number, with a reference's row left out where there are many."""
    coded = tags.dictionary_encode()
    if len(coded.dictionary) > FEW:
        coded = pc.replace_substring_regex(tags, r'( r="[A-Za-z]+)[0-9]+"', r'\1"', max_replacements=1).dictionary_encode()
    found = coded.dictionary.to_pylist()
    if any(not ATTRIBUTES.fullmatch(a) or "xmlns" in a for a in found):
        return None
    return coded.indices.to_numpy(), [dict(ATTRIBUTE.findall(a)) for a in found]


def _numbers(tags: pa.Array, before: int) -> np.ndarray | None:
    """The rows' numbers: all have one, or they are counted."""
    if not pc.all(pc.match_substring_regex(tags, ROW_ATTRIBUTES)).as_py() or pc.any(pc.match_substring(tags, "xmlns")).as_py():
        return None
    if not pc.any(pc.match_substring(tags, " r=")).as_py():
        return np.arange(before + 1, before + 1 + len(tags))
    given = pc.extract_regex(tags, ROW_NUMBER)
    return None if given.null_count else given.field("r").cast(pa.int64()).to_numpy()


def plain(data: bytes, width: int, before: int, value: Callable[[str, str, int], str | None]) -> Rows | None:
    """The rows of ``data``, or None where they are not plain. ``width`` is how many columns are wanted, ``before`` the number of
    the row before; ``value(kind, text, style)`` is the text of a cell that is not a text itself."""
    b = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero((b & 253) == 60)  # < and >, in turn
    lt, gt = edges[::2].copy(), edges[1::2].copy()
    if not len(edges) or len(edges) % 2 or (b[lt] != 60).any() or (b[gt] != 62).any() or not _is_text(data, b):
        return None
    kinds = KIND[b[lt + 1] + (b[lt + 2].astype(np.uint16) << 8)] if lt[-1] + 2 < len(b) else np.zeros(1, np.uint8)
    closed = b[gt - 1] == 47
    kinds[closed] = EMPTY[kinds[closed]]
    fixed = LENGTH[kinds]
    if not kinds.all() or ((fixed > 0) & (fixed != gt - lt)).any() or not FOLLOWS[16 * kinds[:-1] + kinds[1:]].all():
        return None
    if kinds[0] not in (ROW, ROW_EMPTY) or kinds[-1] not in (ROW_END, ROW_EMPTY):
        return None
    rows, cells = np.flatnonzero((kinds == ROW) | (kinds == ROW_EMPTY)), np.flatnonzero((kinds == C) | (kinds == C_EMPTY))
    if (b[lt[rows] + 3] != 119).any() or not np.isin(b[lt[rows] + 4], (32, 47, 62)).all():  # w, and the name's end
        return None
    if (gt[rows] - lt[rows] == len("<row")).all():
        numbers = np.arange(before + 1, before + 1 + len(rows))
    else:
        numbers = _numbers(_texts(data, lt[rows] + 1, gt[rows]), before)
    tags = _attributes(_texts(data, lt[cells] + 2, gt[cells] - (kinds[cells] == C_EMPTY)))
    if numbers is None or tags is None:
        return None
    tag, found = tags

    # The place of each cell: by its reference, or else counted.
    first = np.searchsorted(cells, rows)
    row = np.repeat(np.arange(len(rows)), np.diff(first, append=len(cells)))
    nth = np.array([column(a["r"]) if "r" in a else -1 for a in found], np.int64)[tag]
    if (nth < 0).all():
        nth = np.arange(len(cells)) - first[row]
    elif (nth < 0).any() or ((np.diff(nth) <= 0) & (np.diff(row) == 0)).any():
        return None

    # The texts, and the cells that have one.
    inside = kinds[cells + 1]
    of = np.flatnonzero((inside == V) | (inside == IS))
    inline = inside[of] == IS
    at = cells[of] + 1 + inline
    type_ = [a.get("t", "n") for a in found]
    if (np.array([t == "inlineStr" for t in type_], bool)[tag[of]] != inline).any():
        return None
    begins, ends = gt[at] + 1, lt[at + 1]
    pool, place = [_between(data, begins, ends)], 2 * np.arange(len(at)) + 1
    if b"&" in data:
        try:
            pool, place = [mapped(_texts(data, begins, ends), _decoded)], np.arange(len(at))
        except ElementTree.ParseError:
            return None
    place[ends == begins] = -1
    size = len(pool[0])
    for k, a in enumerate(found):
        if type_[k] in ("n", "s", "b", "e"):
            own = np.flatnonzero((tag[of] == k) & (place >= 0))
            made = mapped(pool[0].take(pa.array(place[own])), lambda text, t=type_[k], s=int(a.get("s", 0)): value(t, text, s))
            pool.append(made)
            place[own] = np.where(made.is_valid().to_numpy(zero_copy_only=False), size + np.arange(len(own)), -1)
            size += len(own)
    there = place >= 0
    filled = np.zeros(len(rows), bool)
    filled[row[of[there]]] = True
    out = np.full((len(rows), width), -1)
    there &= nth[of] < width
    out[row[of[there]], nth[of[there]]] = place[there]
    return Rows(numbers, filled, out, pool[0] if len(pool) == 1 else pa.concat_arrays(pool))


def _is_text(data: bytes, b: np.ndarray) -> bool:
    """Whether it is UTF-8 without characters that XML cannot hold or that a parser changes."""
    low = np.count_nonzero(b < 32)
    if low and low > data.count(b"\n") + data.count(b"\t"):
        return False
    try:
        return data.isascii() or data.decode() is not None
    except UnicodeDecodeError:
        return False
