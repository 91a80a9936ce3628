import numpy as np

from flowlens.llm import fingerprint as fp
from flowlens.llm.words import mix


def plain(text):
    """The walk character by character, time by time."""
    points, out = [ord(c) for c in text], np.zeros(fp.WALKS * fp.SAMPLES, dtype=np.uint8)
    for walk in range(fp.WALKS if points else 0):
        move = np.random.Generator(np.random.Philox(7_000 + walk)).random((fp._PERIOD, fp._CLASSES)) < 0.5
        move[0] = True
        where, time = [], 0  # character read at each time
        for place, point in enumerate(points):
            group = ((point * 0x9E3779B1) & 0xFFFFFFFF) >> 26
            while True:
                where.append(place)
                left = move[time % fp._PERIOD, group]
                time += 1
                if left:
                    break
        draw = mix(np.arange(len(where), dtype=np.uint64) + np.uint64((walk + 1) << 48))
        for box in range(fp.SAMPLES):
            times = [t for t in range(len(where)) if int(draw[t]) % fp.SAMPLES == box]
            if times:
                best = min(times, key=lambda t: (int(draw[t]) >> 8, t))
                value = best
                for k in range(fp.SPAN):
                    at = where[best] + k
                    value = (value * 0xD1342543DE82EF95 + (points[at] if at < len(points) else 0)) % (1 << 64)
                out[walk * fp.SAMPLES + box] = int(mix(np.array([value], dtype=np.uint64))[0]) % 255 + 1
    return out.tobytes()


TEXTS = ["", "a", "ab", "same " * 60, "Ünïcode ▁ 漢字 😀 text\n", "".join(chr(32 + i * 7 % 90) for i in range(400)), "x" * 300]


def test_fingerprints_equal_a_plain_walk():
    assert fp.fingerprints(TEXTS) == [plain(t) for t in TEXTS]


def test_edits_walk_on_from_the_cut():
    edits = [(len(t) - len(t) // 2, TEXTS[k - 1][: len(t) // 2]) for k, t in enumerate(TEXTS)]
    own, edited = fp.fingerprints_with_edits(TEXTS, edits)
    assert own == [plain(t) for t in TEXTS]
    assert edited == [plain(fp.edited_text(t, TEXTS[k - 1])) for k, t in enumerate(TEXTS)]
    assert fp.fingerprints_with_edits(TEXTS, [None] * len(TEXTS))[0] == own
