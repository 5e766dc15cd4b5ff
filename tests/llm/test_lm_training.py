"""The language model's training step against finite differences, and what tasks of one worker share."""

import numpy as np
import pytest

from graphloom.llm import gru_lm


def model_and_docs(scale=0.3):
    rng = np.random.default_rng(7)
    model = gru_lm.Model([(b"", 90), *((b"w%d" % i, 200 - i) for i in range(150))], [4] * gru_lm.OTHER_CLASSES, hidden=8)
    for name, w in model.p.items():
        model.p[name] = (w + scale * rng.standard_normal(w.shape)).astype(np.float32)
    end = model.ids[b""]
    docs = [np.append(rng.integers(0, len(model.cls), n), end).astype(np.int32) for n in (0, 1, 5, 11, 19, 22)]
    return model, docs, np.full(len(docs), end)


def test_training_leaves_the_given_model_as_it_is():
    model, docs, before = model_and_docs()
    was = model.vector().copy()
    fitted = [gru_lm.Trainer(model) for _ in range(2)]
    for trainer in fitted:
        trainer.learn(docs, before, 0.01)
    assert (model.vector() == was).all()
    assert (fitted[0].model.vector() == fitted[1].model.vector()).all() and (fitted[0].model.vector() != was).any()


def test_gradients_equal_finite_differences():
    model, docs, before = model_and_docs()
    trainer = gru_lm.Trainer(model)
    trainer.learn(docs, before, 0.0)  # one window: the first moments are its gradients
    assert trainer.t == 1
    got, at = {"X": trainer.mx}, 0
    for name, shape in (("U", (8, 24)), ("b", (24,)), ("top", trainer.joined[0].shape), ("words", trainer.joined[1].shape)):
        got[name] = trainer.m[at : at + np.prod(shape)].reshape(shape)
        at += np.prod(shape)
    got |= {"C": got["top"][:-1], "c": got["top"][-1], "W": got["words"][:, :-1], "w": got["words"][:, -1]}
    for name, was in list(model.p.items()):
        size, ends = np.linalg.norm(got[name]), []
        for step in (0.02, -0.02):
            model.p[name] = (was + step * got[name] / size).astype(np.float32)
            ends.append(-model.score(docs).sum() / sum(map(len, docs)))
        model.p[name] = was
        assert (ends[0] - ends[1]) / 0.04 == pytest.approx(size, rel=0.02), name


def test_sums_that_leave_the_range_of_numbers_are_taken_from_the_maximum():
    model, docs, before = model_and_docs(scale=60.0)
    values, grad = [], tuple(np.empty_like(x) for x in model.joined())
    h, y = np.tanh(np.random.default_rng(1).standard_normal((40, 8))).astype(np.float32), np.arange(40) * 5
    for careful in (False, True):
        values.append(model.output(h, y, model.joined(), grad, careful))
        assert all(np.isfinite(x).all() for x in (*values[-1], *grad))
    assert all((a == b).all() for a, b in zip(*values, strict=True))
