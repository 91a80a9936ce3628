"""Texts cut where every byte-level and piece vocabulary cuts them.

A unit begins at a space that stands between two characters that are no white
space; no match of a tokenizer's pattern and no piece spans such a place.  Most
texts hold single spaces only and are cut by Arrow, all of a batch together.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BESIDE = re.compile(r"\s | \s")
_CUT = re.compile(r"(?<=\S)(?= \S)")
#: The same for Arrow, whose white space is ASCII's only: white space beside a space, or at an end of the text.
_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_WHITE_BESIDE = f"{_WHITE} | {_WHITE}|^{_WHITE}|{_WHITE}$"


def units_of(text: str, led: bool) -> list[str]:
    """The units of a text, or with ``led`` of a space and the text."""
    if led:
        text = " " + text
    if not text or text[-1].isspace() or _BESIDE.search(text):
        return _CUT.split(text) if text else []
    first, *rest = text.split(" ")
    return ([first] if first else []) + [" " + w for w in rest]


def cut(texts: pa.Array, led: bool) -> tuple[list[np.ndarray], list[str]]:
    """(places of each text's units, different units); a null or empty text has none."""
    texts = texts.fill_null("")
    plain = pc.and_(pc.invert(pc.match_substring_regex(texts, _WHITE_BESIDE)), pc.not_equal(texts, ""))
    parts = pc.split_pattern(texts.filter(plain), " ")
    words = parts.flatten().dictionary_encode()
    units = [" " + w for w in words.dictionary.to_pylist()]
    places = words.indices.to_numpy(zero_copy_only=False).copy()
    edges = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))]).astype(np.int64)
    if not led:  # the first unit of a text has no space
        bare, first = np.unique(places[edges[:-1]], return_inverse=True)
        places[edges[:-1]] = len(units) + first
        units += [units[i][1:] for i in bare.tolist()]
    rows, known, at = [], None, 0
    for easy, text in zip(plain.to_pylist(), texts):
        if easy:
            rows.append(places[edges[at] : edges[at + 1]])
            at += 1
            continue
        known = known if known is not None else {u: i for i, u in enumerate(units)}
        found = units_of(value, led) if (value := text.as_py()) else []
        rows.append(np.fromiter([known.setdefault(u, len(known)) for u in found], dtype=np.int32, count=len(found)))
    return rows, units if known is None else list(known)


def gathered_ids(flat: np.ndarray, edges: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The values of the given runs in a row; run k is ``flat[edges[k] : edges[k + 1]]``."""
    sizes = edges[places + 1] - edges[places]
    return flat[np.arange(int(sizes.sum())) + np.repeat(edges[places] - np.cumsum(sizes) + sizes, sizes)]
