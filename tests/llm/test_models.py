import zlib
from collections import Counter
from pathlib import Path

import helpers
import numpy as np

from flowlens.llm import boosting, quality, toxicity

SF = "/root/testdata/sf0.01"


def test_statistics():
    counts, _ = quality.statistics("a b c a b c\n\na b c a b c\n|x|")
    assert counts == (13, 15, 2, 1, 12)
    assert quality.statistics(None)[0] == quality.statistics(" \n")[0] == (0, 0, 0, 0, 0)
    assert quality.repeated_words("a a a a".split()) == 4 and quality.repeated_words("a b".split()) == 0


def test_trees_follow_their_constraints():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] + 0.3 * np.sin(9 * x[:, 0]) - x[:, 1]) + rng.normal(0, 0.2, 3000) > 0).astype(int)
    trees = boosting.fit(x, y, [1, -1, 0], trees=30)
    grid = np.linspace(0, 1, 200)
    for fixed in (0.1, 0.5, 0.9):
        rising = trees.scores(np.stack([grid, np.full(200, fixed), np.full(200, 0.5)], axis=1))
        falling = trees.scores(np.stack([np.full(200, fixed), grid, np.full(200, 0.5)], axis=1))
        assert (np.diff(rising) >= -1e-12).all() and (np.diff(falling) <= 1e-12).all()
    assert ((trees.scores(x) > 0.5) == y).mean() > 0.8
    assert boosting.fit(x[:5], np.ones(5), [0, 0, 0]).scores(x[:2]).min() > 0.9


def _held_out(frame, labels):
    known = {r.doc_id: r for r in labels.collect()}
    return [(r, known[r.id]) for r in frame.collect() if r.id in known and zlib.crc32(str(r.id).encode()) % 3 == 1]


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    judged = quality.judged(docs, quality.fit_quality(docs, labels))
    pairs = _held_out(judged, labels)
    assert np.mean([(r.score >= 0.5) == bool(k.quality) for r, k in pairs]) > 0.9
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in judged.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == quality.statistics(texts[r.id])[0]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    pairs = _held_out(toxicity.scored(docs, toxicity.fit_toxicity(docs, labels)), labels)
    toxic, plain = [r.score for r, k in pairs if k.toxic], [r.score for r, k in pairs if not k.toxic]
    assert np.mean([a > b for a in toxic for b in plain]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r, _ in pairs)


def test_models_on_awkward_rows(spark):
    docs = helpers.docs(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 0), (4, 0, 1), (5, None, None), (None, 1, 1), (7, 0, 1), (8, 1, 0), (8, 1, 0), (10, 1, 0)], helpers.LABELS)
    judged = quality.judged(docs, quality.fit_quality(docs, labels)).collect()
    scores = toxicity.scored(docs, toxicity.fit_toxicity(docs, labels)).collect()
    assert len(judged) == len(scores) == len(helpers.ROWS)
    assert len({r.score for r in scores if r.id in (4, 5, 6)}) == 1
    empty = spark.createDataFrame([], helpers.LABELS)
    assert quality.fit_quality(docs, empty) is None and toxicity.fit_toxicity(docs, empty) is None
    assert {r.predicted for r in toxicity.scored(docs, None).collect()} == {0}
    assert quality.keep_good(docs, None).columns == toxicity.keep_ordinary(docs, None).columns == docs.columns
    assert quality.judged(helpers.docs(spark, []), None).collect() == []


def test_every_gram_of_the_training_rows_is_evidence(spark):
    """More grams than any table of a fixed size kept on the executors would hold."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rare = [(1_000_000 + i, " ".join(f"{j:x}z{i * 7919 + j * 104729:x}q" for j in range(60))) for i in range(3000)]
    more = spark.createDataFrame(rare, "doc_id long, text string")
    sample = labels.select("doc_id").limit(0).unionByName(more.select("doc_id")).selectExpr("doc_id id", "cast(doc_id % 2 as int) label", "cast(doc_id % 4 div 2 * 2 as int) fold")
    grams, histories = toxicity.fit_evidence(docs.select("doc_id", "text").unionByName(more), sample)
    words = {"\x02" + w + "\x03" for _, t in rare for w in t.split()}
    expected = {w[max(0, e - 6) : e] for w in words for e in range(2, len(w) + 1)}
    assert len(expected) > 1 << 18
    assert grams.count() == len(expected) and histories.count() == len({g[:-1] for g in expected})


def _plain_evidence(texts, labels, order=6, discount=0.75):
    """Kneser-Ney by its definition: evidence of a word under the models of both classes."""

    def grams(text):
        for word in (text or "").lower().split():
            m = "\x02" + word.strip(toxicity._STRIP) + "\x03"
            yield from (m[max(0, e - order) : e] for e in range(2, len(m) + 1))

    known = [Counter(g for t, y in zip(texts, labels) if y == k for g in grams(t)) for k in (1, 0)]
    sets = [{g for t in texts for g in grams(t)}]
    sets = {order: {g for g in sets[0] if len(g) == order}, **{n: {g for g in sets[0] if len(g) == n} for n in range(1, order)}}
    left = {}
    for n in range(order - 1, 0, -1):
        left[n] = Counter(g[1:] for g in sets[n + 1])
        sets[n] |= set(left[n])

    def shared(g):
        same = {x: c for x, c in left[len(g)].items() if x[:-1] == g[:-1]}
        lower = shared(g[1:]) if len(g) > 1 else 1 / (len(same) + 1)
        return (left[len(g)][g] - discount) / sum(same.values()) + discount * len(same) / sum(same.values()) * lower

    def way(k, history):
        same = [c for x, c in known[k].items() if x[:-1] == history]
        return (discount * len(same) / sum(same), sum(same)) if same else (1.0, 0)

    def value(g):
        ways = [way(k, g[:-1]) for k in (0, 1)]
        if not (known[0][g] or known[1][g]):
            return np.log(ways[0][0] / ways[1][0])
        chances = [((known[k][g] - discount) / ways[k][1] if known[k][g] else 0) + ways[k][0] * shared(g[1:]) for k in (0, 1)]
        return np.log(chances[0] / chances[1])

    return grams, value


def test_evidence_is_plain_kneser_ney(spark):
    texts = ["Bad, bad worms eat badly", "good words eat (well)", "bad \x02odd Words", "wörter ▁ 日本語 good good", "unseen badger worded", None, "", "good\x02wormed"]
    labels = [1, 0, 1, 0, None, None, None, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sample = spark.createDataFrame([(i, y, 0 if i < 2 else 2) for i, y in enumerate(labels) if y is not None], "id long, label int, fold int")
    batches = toxicity._batches(docs, sample, "doc_id", "text")
    known, histories = toxicity._evidence(batches)
    grams, value = _plain_evidence(texts, labels)
    got = {r.gram: r["all"] for r in toxicity._gram_values(batches, known, histories, ("all",)).collect()}
    assert set(got) == {g for t in texts for g in grams(t)}
    for g in got:
        assert abs(got[g] - value(g)) < 1e-9, g


def test_scores_do_not_depend_on_batches(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_toxicity(docs, labels)
    whole = {r.id: r.score for r in toxicity.scored(docs, model).collect()}
    others = docs.repartition(40)
    monkeypatch.setattr(toxicity, "ROUNDS", 3)
    again = {r.id: r.score for r in toxicity.scored(others, model).collect()}
    assert set(whole) == set(again) and max(abs(whole[k] - again[k]) for k in whole) < 1e-9
    kept = sorted(r.doc_id for r in toxicity.keep_ordinary(others, model).collect())
    assert kept == sorted(k for k in whole if whole[k] < toxicity.THRESHOLD)


def test_no_texts_are_stored(spark, tmp_path):
    """Texts that were stored and the grams of all words took several times the input."""
    rng = np.random.default_rng(1)
    words = [f"{w:x}word{w * 7919 % 1000}" for w in range(500)]
    rows = [(i, " ".join(words[w] for w in rng.integers(0, 500, 3000))) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(200)], helpers.LABELS)
    size = lambda folder, but=(): sum(f.stat().st_size for f in folder.rglob("*.parquet") if f not in but)
    work = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(work.rglob("*.parquet"))
    assert len(toxicity.scored(docs, toxicity.fit_toxicity(docs, labels)).collect()) == 200
    assert size(work, before) < size(tmp_path / "docs")
