"""The labels of the stretches that are decoded are those of whole texts."""

import os

import numpy as np
import pytest

from newsweir.llm.personal import _LABELS, _OFFSETS, Finder, Recogniser
from newsweir.llm.pii_examples import filled

DATA = "/root/testdata/sf0.001"


def whole(finder, text):
    """The best path over all tokens of one text, by plain Viterbi in double precision, and its score."""
    token = [t for c in text.split(" ") for t in finder.chunks[c]]
    e = np.zeros((len(token), _LABELS))
    for i in range(len(token)):
        for o, off in enumerate(_OFFSETS):
            if 0 <= i + off < len(token):
                e[i] += finder.table[token[i + off], o]
    trans, score, back = finder.model.trans.astype(float), e[0], []
    for x in e[1:]:
        s = score[:, None] + trans
        back.append(s.argmax(0))
        score = s.max(0) + x
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.array(token, np.int32), np.array(path[::-1]), e, trans


def agree(finder, texts):
    held = 0
    for text in filter(None, texts):
        token, path, e, trans = whole(finder, text)
        if not len(token):
            continue
        got = finder.labels(token, np.zeros(len(token), np.int32)).astype(int)
        if (got != path).any():  # only where two paths are equally good
            best, own = (e[np.arange(len(p)), p].sum() + trans[p[:-1], p[1:]].sum() for p in (path, got))
            assert own == pytest.approx(best, abs=1e-3), text
        held += int((path > 0).any())
    return held


@pytest.fixture(scope="module")
def listed(spark):
    rows = spark.read.parquet(f"{DATA}/name_list.parquet").filter("name is not null").select("name", "name_kind").distinct().collect()
    return [[r["name"] for r in rows if r["name_kind"] == k] for k in ("given", "family")]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_stretches_are_whole_decoding(spark, listed):
    finder = Finder(Recogniser(*listed))
    texts = [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    assert agree(finder, texts) > 10
    # Many texts at once are the same chains as each alone.
    assert finder.find(texts) == [finder.find([t])[0] for t in texts]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_labels_by_context_alone(listed):
    """Transitions that make labels cheap: where no token speaks for itself, the best path must still be found."""
    model = Recogniser(*listed)
    finder = Finder(model)
    kept, rng = model.trans, np.random.default_rng(1)
    try:
        for strength in (1.0, 4.0):
            model.trans = kept + rng.normal(0, strength, kept.shape).astype(np.float32)
            assert agree(finder, [t for t, _ in filled(1, seed=5)][:150]) > 10
    finally:
        model.trans = kept
