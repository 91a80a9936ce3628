"""The token operators restated with the libraries, text by text."""

from __future__ import annotations

import base64
import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers


def rank_ids(name):
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return encoding.encode_ordinary


def merge_digest(encode, text):
    ids = encode(text or "")
    return len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def alignments(texts, first, second):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each text."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path(first))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(second))
    entry = {i: t for t, i in a.get_vocab().items()}
    value = {}
    spare = 256
    for byte in range(256):
        shown = 0x21 <= byte <= 0x7E or 0xA1 <= byte <= 0xAC or 0xAE <= byte
        value[chr(byte if shown else spare)] = byte
        spare += not shown

    found, documents = [], Counter()
    for text in texts:
        if not text:
            found.append(None)
            continue
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        spelled = (
            [bytes(value[c] for c in entry[i]) for i in ids[0]],
            [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]],
        )
        if any(b"".join(s) != (" " + text).encode() for s in spelled):
            found.append(None)
            continue
        ends = [np.cumsum([len(t) for t in s]).tolist() for s in spelled]
        groups, links, at = [], Counter(), [0, 0]
        for end in sorted(set(ends[0]) & set(ends[1])):
            sides = []
            for k in (0, 1):
                to = ends[k].index(end, at[k]) + 1
                sides.append(ids[k][at[k] : to])
                at[k] = to
            groups.append("|".join(",".join(map(str, s)) for s in sides))
            links.update((x, y) for x in sides[0] for y in sides[1])
        found.append((len(ids[0]), len(ids[1]), groups, links))
        documents.update(links.keys())
    best = defaultdict(int)
    for (x, _), n in documents.items():
        best[x] = max(best[x], n)
    out = []
    for one in found:
        if one is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = one
        top = sum(n for p, n in links.items() if documents[p] == best[p[0]])
        out.append((n_a, n_b, len(groups), links.total(), top, sum(n * documents[p] for p, n in links.items()), ";".join(groups)))
    return out
