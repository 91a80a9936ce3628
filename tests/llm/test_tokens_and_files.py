import zlib
from collections import Counter, defaultdict

import helpers
import numpy as np
import pytest
from tokenizers import Tokenizer

from flowlens.llm import order, packing, pieces, sharding, tokens, wavelet

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "  a", "a ", "a  b\n\n c", "\n", "x \n y", "don't  Stop, É. <|endoftext|> ΑΣ ΣΑΣ é", "1 22 3,4 _a_ a..b ... ", "a<|endoftext|>b <|startoftext|><|endoftext|>c <|ENDOFTEXT|>", "<|endoftext|>", "x\n<|endoftext|> \n y", "\t\ta b   c\x1cd \x1c e"]


def _plain(name, texts):
    tokenizer = Tokenizer.from_file(tokens.vocabulary(name))
    return [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name, words_only", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_pieces_give_the_ids_of_whole_texts(spark, name, words_only):
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    encoder = tokens.Encoder(tokens.vocabulary(name), words_only, memo_pieces=2000)
    for _ in range(2):
        assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == _plain(name, texts)


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for size, top in ((0, 1), (1, 1), (7, 3), (5000, 40), (9000, 50257), (300, 70000)):
        ids = rng.integers(0, top, size)
        matrix, documents, lengths = wavelet.from_blob(wavelet.to_blob(ids, [3, None], [size, 0]))
        assert (matrix.all() == ids).all() and documents.tolist() == [3, wavelet._NULL] and lengths.tolist() == [size, 0]
        for at in rng.integers(0, size, 20) if size else ():
            token, lo, hi = int(ids[at]), *sorted(rng.integers(0, size + 1, 2).tolist())
            assert matrix.access(int(at)) == token and matrix.count(token, lo, hi) == (ids[lo:hi] == token).sum()
            assert matrix.occurrences(token) == np.flatnonzero(ids == token).tolist()
        assert matrix.count(1 << 20) == 0


def test_token_files_round_trip(spark):
    rows = [(d, t) for d, t, *_ in helpers.ROWS]
    want, at = Counter(), 0
    in_order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    for (doc, _), ids in zip(in_order, _plain("byte_bpe_50k.json", [t for _, t in in_order])):
        ids = [*ids, 2]
        want[doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        at += len(ids)
    assert Counter(map(tuple, wavelet.token_digest(helpers.docs(spark), block_tokens=500).collect())) == want
    assert wavelet.token_digest(helpers.docs(spark, [])).collect() == []


def test_packing(spark):
    got = packing.packed(helpers.docs(spark)).collect()
    want = Counter((d, len(i) + 1) for (d, *_), i in zip(helpers.ROWS, _plain("word_bpe_49k.json", [r[1] for r in helpers.ROWS])))
    assert Counter((r.doc_id, r.doc_tokens) for r in got if r.start == 0) == want
    assert sum(r.length for r in got) == sum(n * c for (_, n), c in want.items())
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert packing.packed(helpers.docs(spark, [])).collect() == []


def test_patterns_hold_every_length():
    rng = np.random.default_rng(3)
    for histogram in ({5: 1000}, {4096: 3, 1: 9000}, {int(k): int(n) for k, n in zip(rng.integers(1, 4097, 500), rng.integers(1, 50, 500))}):
        patterns = packing.patterns_of(histogram)
        used = Counter()
        for count, runs in patterns:
            assert sum(length * times for length, times in runs) <= 4096
            for length, times in runs:
                used[length] += count * times
        assert used == histogram
        tokens_in = sum(k * n for k, n in histogram.items())
        assert tokens_in / (4096 * sum(c for c, _ in patterns)) > (0.95 if len(histogram) > 2 else 0.4)


def _jump(key, shards):
    m = (1 << 64) - 1
    key &= m
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        key = (key ^ key >> shift) * factor & m
    key ^= key >> 31
    at, ahead = -1, 0
    while ahead < shards:
        at, key = ahead, (key * 2862933555777941757 + 1) & m
        ahead = int((at + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return at


def test_sharding(spark):
    got = sharding.sharded(helpers.docs(spark), 24).collect()
    assert len(got) == len(helpers.ROWS)
    for r in got:
        key = sharding._NULL_KEY if r.id is None else r.id
        assert (r.shard, r.grown_shard) == (_jump(key, 24), _jump(key, 25))
    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in helpers.ROWS)
    assert Counter((r.id, r.size, r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    keys = np.arange(200_000)
    old, new = sharding.jump_hash(keys, 24), sharding.jump_hash(keys, 25)
    assert set(new[old != new]) == {24} and 0.03 < (old != new).mean() < 0.05 and np.bincount(old).min() > 7800
    assert sharding.sharded(helpers.docs(spark, []), 24).collect() == []


def test_ranks_of_one_large_group(spark):
    rows = spark.range(5000).selectExpr("id % 2 * 0 AS g", "5000 - id AS o").unionByName(spark.createDataFrame([(1, 3), (1, 3)], "g long, o long"))
    got = order.ranked(rows, "g", ["o"]).collect()
    assert sorted(r.rank for r in got if r.g == 0) == list(range(5000)) and sorted(r.rank for r in got if r.g == 1) == [0, 1]
    assert all(r.rank == r.o - 1 for r in got if r.g == 0)


def _all_paths(model, segment):
    out = []

    def go(at, ids, score):
        if at == len(segment):
            out.append((score, tuple(ids)))
            return
        own = False
        for end in range(at + 1, len(segment) + 1):
            found = model.table.get(segment[at:end])
            if found:
                own = own or end == at + 1
                go(end, [*ids, found[0]], score + found[1])
        if not own:
            extra, score_of = model._edge(segment[at])
            go(at + 1, [*ids, *extra], score + score_of)

    go(0, [], 0)
    return sorted(out, reverse=True)


def test_n_best_paths_equal_brute_force():
    import sentencepiece

    model = pieces.piece_model()
    library = sentencepiece.SentencePieceProcessor(model_file=tokens.vocabulary(pieces.VOCABULARY))
    texts = ["the cat", "hello", "a  b", "x\ny", " ab", "日本 a", "über all", "é e", "\n\n", "ab ", "▁x", "there no.", "innate", "tttt"]
    for text, paths in zip(texts, model.encode(texts, 4)):
        every = _all_paths(model, pieces.MARK + text.replace(" ", pieces.MARK))
        assert [s for s, _ in paths] == [s for s, _ in every[:4]]
        ids = [tuple(np.frombuffer(p, "<u4").tolist()) for _, p in paths]
        assert len(set(ids)) == len(ids) and all((s, i) in set(every) for (s, _), i in zip(paths, ids))
        for (_, packed), row in zip(paths, ids):
            assert model.decode(packed) == library.decode(list(row)) == text.replace(pieces.MARK, " ")


def test_piece_paths_of_awkward_rows(spark):
    got = pieces.encoded(helpers.docs(spark)).collect()
    assert len(got) == len(helpers.ROWS) and all(r.decoded_equal and r.scores == sorted(r.scores, reverse=True) for r in got)
    assert {r.n_pieces for r in got if r.id in (4, 5)} == {0}
    assert pieces.encoded(helpers.docs(spark, [])).collect() == []
