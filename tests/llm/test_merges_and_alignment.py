import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from helpers import DOCS, ROWS, docs
from plain_tokens import alignments, merge_digest, rank_ids

from flowlens.llm import alignment, merges, perfect, queries

SMALL = "/root/testdata/sf0.001"
ODD = [
    "a  b", "  x", "x ", " ", "a▁b", "<s> <|endoftext|> hi", "é😀漢字 ​ z", "a\nb \r\n c", "=" * 5000, "tab\t x\x1c y", "haha" * 3000,
    "don't 'll'LL 12ab34", "՘ᇞ0 newer Ɤ", "\n\n  \n x  ", "a" * 70000,
]


def _odd_rows(n=200):
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choices("ab \n\té漢😀▁='s1", k=rng.randrange(40))) for _ in range(n)]
    return ROWS + [(1000 + i, t, None, None) for i, t in enumerate(texts)]


def test_merges_equal_the_library(spark):
    rows, encode = _odd_rows(), rank_ids(merges.VOCABULARY)
    # two words in the lexicon, all, and none
    for words in (merges.LEXICON_WORDS, 8, 0):
        got = merges.decoded(merges.encoded(docs(spark, rows), lexicon_words=words))
        got = got.selectExpr("id", "n_tokens", "sha2(ids, 256)", "sha2(bytes, 256)").collect()
        assert Counter(map(tuple, got)) == Counter((doc, *merge_digest(encode, text)) for doc, text, *_ in rows)


def test_merge_query(spark):
    texts = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    encode = rank_ids(merges.VOCABULARY)
    got = queries.op11_merge_replay(spark, SMALL).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert Counter(map(tuple, got)) == Counter((r.doc_id, *merge_digest(encode, r.text)) for r in texts)


class _Ranks(merges.Replay):
    """A vocabulary in which a merge makes a pair of lower rank."""

    def __init__(self, tokens):
        self.ranks = {bytes([b]): 1000 + b for b in range(256)} | tokens
        self.token_of = {r: t for t, r in self.ranks.items()}
        self.byte_ranks = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                if token[:cut] in self.ranks and token[cut:] in self.ranks:
                    pairs[self.ranks[token[:cut]] << 32 | self.ranks[token[cut:]]] = rank
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], dtype=np.int64)


def test_pairs_of_lower_rank_come_first():
    import tiktoken

    rng = random.Random(3)
    for _ in range(30):
        tokens = {}
        while len(tokens) < 25:
            tokens.setdefault("".join(rng.choices("abc", k=rng.randrange(2, 6))).encode(), len(tokens))
        model = _Ranks(tokens)
        encoding = tiktoken.Encoding("t", pat_str=r"[a-c]+", mergeable_ranks=model.ranks, special_tokens={})
        words = ["".join(rng.choices("abc", k=rng.randrange(1, 30))) for _ in range(200)]
        ids, edges = model.ids([w.encode() for w in words])
        for word, a, b in zip(words, edges, edges[1:]):
            assert ids[a:b].tolist() == encoding.encode_ordinary(word)


def test_frequent_words_keep_the_bound(spark):
    counts = spark.createDataFrame([(f"w{i}", 1 + i % 40) for i in range(400)], "word string, n long")
    assert merges.frequent(counts, 0).count() == 0 and merges.frequent(counts, 400).count() == 400
    for bound in (1, 10, 55, 399):
        kept = merges.frequent(counts, bound).collect()
        assert len(kept) <= bound and (not kept or min(r.n for r in kept) > 1)


def _columns(rows):
    return Counter((r.id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in rows)


@pytest.mark.parametrize("slice_pairs", [alignment.SLICE_PAIRS, 1])
def test_alignment_equals_the_libraries(spark, monkeypatch, slice_pairs):
    rows = _odd_rows()
    if slice_pairs == 1:  # many shards, a slice each
        monkeypatch.setattr(perfect, "SHARD_KEYS", 500)
    got = alignment.aligned(docs(spark, rows), slice_pairs=slice_pairs).collect()
    want = alignments([text for _, text, *_ in rows], alignment.FIRST, alignment.SECOND)
    assert _columns(got) == Counter((doc, *w) for (doc, *_), w in zip(rows, want))


def test_alignment_query(spark):
    texts = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = alignments([r.text for r in texts], alignment.FIRST, alignment.SECOND)
    got = {r.doc_id: r for r in queries.op12_token_alignment(spark, SMALL).collect()}
    assert len(got) == len(texts)
    for row, (n_a, n_b, n_groups, n_links, n_best, count_sum, groups) in zip(texts, want):
        r = got[row.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == (n_a, n_b, n_groups, n_links, n_best, count_sum)
        assert len(r.groups_sha256) == (64 if groups else 0)


def test_tables_without_rows(spark):
    empty = spark.createDataFrame([], DOCS)
    assert merges.encoded(empty).count() == 0
    assert alignment.aligned(empty).count() == 0


def test_perfect_hash(spark):
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 48, 70000))
    number = perfect.number_of_shards(len(keys)) * 3
    built = perfect.shards(spark.createDataFrame([(int(k),) for k in keys], "key long"), number).toArrow()
    whole = perfect.PerfectHash(built, number, 0, number)
    assert np.array_equal(np.sort(whole.numbers(keys)), np.arange(len(keys)))
    strange = np.setdiff1d(rng.integers(0, 1 << 48, 5000), keys)
    assert (whole.numbers(strange) == -1).all()
    assert 8 * whole.words.nbytes / len(keys) < 5
    assert perfect.settle(np.zeros(0, np.int64))[0] == []


def test_vocabularies_are_not_copied():
    assert public_tokenizers.path(merges.VOCABULARY).startswith(public_tokenizers.path(""))
